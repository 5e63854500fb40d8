"""Growth of a schema: a field is held out until it is introduced, and then joins the combination at once or after a waiting time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fisher_tail
from ..plans.ranks import numbered, prefix

#: Treatments: "A" waits for a number of the field's verdicts since its introduction, "B" takes them at once.
TREATMENTS = ("A", "B")


def held_out(v: DataFrame, fields: tuple[str, ...], introduced: int, wait: int = 1000) -> DataFrame:
    """h, treatment, off, at, j and p: Fisher's combination of each event's verdicts ``v`` (off, at, field, p), with each of ``fields`` held out in turn.

    A field's verdicts count from ``introduced`` on; under treatment A only when ``wait`` events since then had one before. That
    number is a rank in the order of time over ranges of it, so no task holds a field. An event without any verdict left has no row.
    """
    x = v.select("off", "at", "field", "p", F.explode(F.array(*map(F.lit, fields))).alias("h")).withColumn("own", F.col("field") == F.col("h"))
    later = x.where(F.col("own") & (F.col("at") >= introduced))
    x = x.where("not own").select("h", "off", "at", "p", F.lit(True).alias("a"), F.lit(True).alias("b"))
    later = numbered(later, ["at", "off"], ["h"]).select("h", "off", "at", "p", (F.col("rank") > wait).alias("a"), F.lit(True).alias("b"))
    terms = [(F.count_if(t).alias(f"j_{t}"), F.sum(F.when(F.col(t), -2 * F.log("p"))).alias(f"x_{t}")) for t in "ab"]
    g = x.unionByName(later).groupBy("h", "off").agg(F.first("at").alias("at"), *(c for pair in terms for c in pair))
    both = F.explode(F.array(*(F.struct(F.lit(t).alias("treatment"), F.col(f"j_{t.lower()}").alias("j"), F.col(f"x_{t.lower()}").alias("x2")) for t in TREATMENTS))).alias("t")
    return g.select("h", "off", "at", both).select("h", "t.treatment", "off", "at", "t.j", "t.x2").where("j > 0").select("h", "treatment", "off", "at", "j", fisher_tail(F.col("x2"), F.col("j")).alias("p"))


def discoveries(tests: DataFrame, day: Column, introduced_day: int, levels: tuple[float, ...], keys: tuple[str, ...] = ("h", "treatment")) -> DataFrame:
    """By ``keys``, era ("pre", "post") and level q: discoveries, hits, days and fdr (1 - hits / discoveries, null without any).

    ``tests`` has off, p and red (0 or 1). Each day is cut at its largest rank i with p <= i q / m, where m is the mean number of events a
    day; p is compared in nine decimals, ties by off. Ranks and hits are running sums over ranges of the order: all tests take part.
    """
    x = tests.withColumn("day", day).withColumn("q9", F.round("p", 9))
    m = tests.agg((F.count_distinct("off") / F.count_distinct(day)).alias("m"))
    ranked = prefix(x, [*keys, "day"], ["q9", "off"], {"rank": F.lit(1).cast("long"), "hits": F.col("red").cast("long")}).crossJoin(F.broadcast(m))  # a single row
    cuts = [F.max(F.when(F.col("q9") <= F.col("rank") * q / F.col("m"), F.struct("rank", "hits"))).alias(f"c{i}") for i, q in enumerate(levels)]
    days = ranked.groupBy(*keys, "day").agg(*cuts)
    at = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"c{i}").alias("c")) for i, q in enumerate(levels)))).alias("l")
    days = days.select(*keys, F.when(F.col("day") < introduced_day, "pre").otherwise("post").alias("era"), at)
    found, hits = (F.coalesce(F.sum(f"l.c.{c}"), F.lit(0).cast("long")) for c in ("rank", "hits"))
    out = days.groupBy(*keys, "era", F.col("l.q").alias("q")).agg(F.count("*").alias("days"), found.alias("discoveries"), hits.alias("hits"))
    return out.withColumn("fdr", F.when(F.col("discoveries") > 0, 1 - F.col("hits") / F.col("discoveries")))


def information(e: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """f_a, f_b, n and mi (nats) for all pairs of fields, over the events that have both; a count by pair of values is all that is shuffled."""
    names = sorted(fields)
    pairs = F.array(*(F.struct(F.lit(a).alias("f_a"), F.lit(b).alias("f_b"), fields[a].cast("string").alias("v_a"), fields[b].cast("string").alias("v_b")) for i, a in enumerate(names) for b in names[i + 1 :]))
    c = e.select(F.explode(pairs).alias("p")).select("p.*").where("v_a is not null and v_b is not null").groupBy("f_a", "f_b", "v_a", "v_b").agg(F.count("*").alias("c"))
    by = lambda *k: c.groupBy("f_a", "f_b", *k).agg(F.sum("c").alias("".join(k) + "_n"))
    x = c.join(by("v_a"), ["f_a", "f_b", "v_a"]).join(by("v_b"), ["f_a", "f_b", "v_b"]).join(by(), ["f_a", "f_b"])
    share = F.col("c") / F.col("_n")
    return x.groupBy("f_a", "f_b").agg(F.first("_n").alias("n"), F.sum(share * F.log(F.col("c") * F.col("_n") / (F.col("v_a_n").cast("double") * F.col("v_b_n")))).alias("mi"))


def nearest_information(mi: DataFrame) -> DataFrame:
    """h, nearest and mi: for each field the other that tells most of it; ties (in nine decimals) to the smaller name."""
    both = mi.select(F.col("f_a").alias("h"), F.col("f_b").alias("o"), "mi").unionAll(mi.select("f_b", "f_a", "mi"))
    w = Window.partitionBy("h").orderBy(F.desc(F.round("mi", 9)), "o")  # as many rows as fields
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("h", F.col("o").alias("nearest"), "mi")
