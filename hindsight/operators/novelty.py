"""Value novelty: decayed predictive estimates over an entity's own earlier values, and their tails.

Counts and tails come from ``tails.value_tails``: one keyed pass over all fields that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sidak
from ..plans.conform import HALF_LIFE, before, by_entity, weight
from .tails import value_tails

ALPHA = 1.0


def dirichlet(e: DataFrame, field: str, alpha: float = ALPHA, half_life: int = HALF_LIFE) -> DataFrame:
    """off, ent, at, n_v, n, k and p of every event that has the settled field.

    The predictive mass of a value is (n_u + alpha) / (n + alpha (k + 1)); p is the sum of the masses
    that are no larger than the observed one, with the reserve for what was never seen. Without history p is 1.
    """
    return value_tails(e, {field: F.col(field)}, alpha=alpha, half_life=half_life).select("off", "ent", "at", "n_v", "n", "k", "p")


def good_turing(e: DataFrame, field: str, alpha: float = ALPHA, least: float = 30.0, half_life: int = HALF_LIFE) -> DataFrame:
    """As ``dirichlet``, but the reserve is the share of values with a decayed count within 1 +- 0.25, at most 0.99, where that is larger and n is at least ``least``."""
    return value_tails(e, {field: F.col(field)}, alpha=alpha, half_life=half_life, least=least).select("off", "ent", "at", "n1", "reserve", "p")


PAIRS = (("event_type", "k"), ("band", "event_type"), ("band", "k"))


def pair_fields(pairs: tuple[tuple[str, str], ...] = PAIRS) -> dict[str, Column]:
    """Each pair of fields as a field of its own; an event that lacks one of them lacks the pair."""
    return {f"{a}\u00d7{b}": F.concat(a, F.lit("\x1f"), b) for a, b in pairs}


def least_of_pairs(found: DataFrame) -> DataFrame:
    """off, ent, at, tests, min_p and p: the least tail of an event's pairs, corrected for their number."""
    return found.groupBy("off", "ent", "at").agg(F.count("*").alias("tests"), F.min("p").alias("min_p")).withColumn("p", sidak(F.col("min_p"), F.col("tests")))


def pairing(e: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """off, ent, at, tests, min_p and p: the least novelty tail over the pairs of fields, corrected for their number."""
    return least_of_pairs(value_tails(e, pair_fields(pairs)))


def population(e: DataFrame, field: str, alpha: float = ALPHA, least: float = 1000.0, most_values: int = 1000, half_life: int = HALF_LIFE) -> DataFrame:
    """off, ent, at, n_v, n, k, status and p against the counts of the whole population before the event.

    The population is one key, which is cut along time. The arm abstains where the decayed total is below
    ``least``, or where more than ``most_values`` values had been seen.
    """
    x = value_tails(e, {field: F.col(field)}, key=None, alpha=alpha, half_life=half_life)
    enough = (F.col("n") >= least) & (F.col("k") <= most_values)
    return x.select("off", "ent", "at", "n_v", "n", "k", F.when(enough, "evaluated").otherwise("abstained_structural").alias("status"), F.when(enough, F.col("p")).alias("p"))


def first_seen(e: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """off, ent, at and novel: whether any field's value is the entity's first of it among settled events."""
    rows = by_entity(e.where("known").select("off", "ent", "at", *fields))
    novel = F.lit(False)
    for f in fields:
        earlier = F.coalesce(F.count("*").over(before("ent", f)), F.lit(0))
        novel = novel | (F.col(f).isNotNull() & (earlier == 0))
    return rows.select("off", "ent", "at", novel.alias("novel"))


def novelty_rate(e: DataFrame, fields: tuple[str, ...] = ("event_type", "k"), least: float = 50.0, half_life: int = HALF_LIFE, window: int = 3_600_000_000) -> DataFrame:
    """off, ent, at, k, m, h_novel, h_total and status: novel events among those of the hour so far, and the decayed history of finished hours.

    A finished hour joins the history undecayed at the first event of a later hour; from then on it decays.
    """
    rows = first_seen(e, fields).withColumn("hour", F.floor(F.col("at") / window))
    here = Window.partitionBy("ent", "hour").orderBy("at", "off").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("m", F.count("*").over(here)).withColumn("k", F.sum(F.col("novel").cast("long")).over(here))
    # at an hour's first event, the event before it has the counts of the hour that has finished
    order, own = Window.partitionBy("ent").orderBy("at", "off"), weight(F.col("at"), half_life)
    for name, count in (("_t", "m"), ("_h", "k")):
        rows = rows.withColumn(name, F.when(F.col("m") == 1, F.lag(count).over(order)))
    past = lambda x: F.coalesce(F.sum(F.col(x) * own).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) / own
    out = rows.select("off", "ent", "at", "k", "m", past("_h").alias("h_novel"), past("_t").alias("h_total"))
    return out.withColumn("status", F.when(F.col("h_total") >= least, "evaluated").otherwise("abstained_structural"))
