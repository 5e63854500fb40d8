"""Co-occurrence of all values that stand together in an event, against a Poisson block model of the graph before it.

Nodes are (field, value). An event with F of the fields holds F (F - 1) / 2 edges, and adds F - 1 to the degree of each
of its nodes. All that an event is compared with is a decayed prefix sum, taken in two levels by hour, so that neither a
frequent value nor the whole graph is one task's work. No step grows beyond events x pairs of their own fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sidak_log
from ..plans.conform import HALF_LIFE, HOUR, running, weight
from ..plans.store import cut

_NODE = "struct<field:string,value:string,k:double,block:string,d:double>"


def _hour() -> Column:
    return F.floor(F.col("at") / HOUR).cast("long")


def nodes_of(e: DataFrame, fields: dict[str, Column], half_life: int = HALF_LIFE) -> DataFrame:
    """off, ent, at, own (the event's weight) and nodes: its (field, value) in the order of fields, null values left out."""
    listed = F.array(*(F.struct(F.lit(f).alias("field"), fields[f].cast("string").alias("value")) for f in sorted(fields)))
    return e.where("known").select("off", "ent", "at", weight(F.col("at"), half_life).alias("own"), F.filter(listed, lambda x: x["value"].isNotNull()).alias("nodes"))


def priced_pairs(e: DataFrame, fields: dict[str, Column], blocks: DataFrame | None = None, half_life: int = HALF_LIFE) -> DataFrame:
    """Each pair of each known event of ``e``: off, ent, f_a, v_a, f_b, v_b, w, k_a, k_b, total, d_r, d_s, m_rs, lam and fallback.

    ``w`` is the edge's weight before the event, ``k_a`` and ``k_b`` its nodes' degrees, ``total`` the graph's weight, all decayed
    to the event. ``blocks`` (field, value, block; a node once) gives a partition, whose blocks lie within fields; ``d_r``, ``d_s``
    and ``m_rs`` are its blocks' degrees and the weight between them, from the same prefix (weight inside a block counts from both
    ends). ``lam`` is k_a k_b m_rs / (d_r d_s), or k_a k_b / 2 total (``fallback``) where a node has no block or a block no weight yet.
    An event with fewer than two values has no pair and no row; an empty table gives none.
    """
    if blocks is None:
        return _plain_pairs(e, fields, half_life)
    x = nodes_of(e, fields, half_life).where(F.size("nodes") >= 2)
    f = F.size("nodes")
    x = running(x.withColumn("all", F.lit(0)), ["all"], {"wt": F.col("own") * f * (f - 1) / 2}, _hour()).drop("all")
    n = x.select("off", "ent", "at", "own", "wt", F.explode("nodes").alias("n"), (f - 1).alias("others")).select("off", "ent", "at", "own", "wt", "others", "n.field", "n.value")
    added = F.col("own") * F.col("others")
    # a two-level sum reads its rows twice: without a cut, each step would double the readings of those before it
    n = cut(running(n, ["field", "value"], {"k": added}, _hour()))
    n = n.join(blocks.select("field", "value", "block"), ["field", "value"], "left")
    # an event may reach a block through several of its nodes: one row of it
    reached = n.where("block is not null").groupBy("block", "off", "at").agg(F.sum(added).alias("add"))
    n = n.join(running(reached, ["block"], {"d": F.col("add")}, _hour()).select("block", "off", "d"), ["block", "off"], "left")
    g = n.groupBy("off").agg(
        *(F.first(c).alias(c) for c in ("ent", "at", "own", "wt")), F.sort_array(F.collect_list(F.struct("field", "value", "k", "block", "d"))).cast(f"array<{_NODE}>").alias("nodes")
    )  # as many nodes as an event has fields
    pair = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = g.select("off", "ent", "at", "own", "wt", F.explode(pair).alias("p"))
    ends = {"f": "field", "v": "value", "k": "k", "d": "d"}
    p = p.select("off", "ent", "at", "own", "wt", *(F.col(f"p.{s}.{c}").alias(f"{n}_{s}") for s in "ab" for n, c in ends.items()), F.col("p.a.block").alias("r"), F.col("p.b.block").alias("s"))
    p = cut(running(p, ["f_a", "v_a", "f_b", "v_b"], {"w": F.col("own")}, _hour()))
    p = p.withColumn("lo", F.least("r", "s")).withColumn("hi", F.greatest("r", "s"))
    twice = F.when(F.col("lo") == F.col("hi"), 2.0).otherwise(1.0)
    met = p.where("r is not null and s is not null").groupBy("lo", "hi", "off", "at").agg(F.sum(F.col("own") * twice).alias("add"))
    p = p.join(running(met, ["lo", "hi"], {"m": F.col("add")}, _hour()).select("lo", "hi", "off", "m"), ["lo", "hi", "off"], "left")
    own = F.col("own")
    fallback = ~F.coalesce((F.col("d_a") > 0) & (F.col("d_b") > 0) & F.col("r").isNotNull() & F.col("s").isNotNull(), F.lit(False))
    plain = F.when(F.col("wt") > 0, F.col("k_a") * F.col("k_b") / (2 * F.col("wt")) / own).otherwise(0.0)
    lam = F.when(fallback, plain).otherwise(F.col("k_a") * F.col("k_b") / own * F.coalesce("m", F.lit(0.0)) / (F.col("d_a") * F.col("d_b")))
    return p.select(
        "off", "ent", "f_a", "v_a", "f_b", "v_b", (F.col("w") / own).alias("w"), (F.col("k_a") / own).alias("k_a"), (F.col("k_b") / own).alias("k_b"), (F.col("wt") / own).alias("total"),
        (F.col("d_a") / own).alias("d_r"), (F.col("d_b") / own).alias("d_s"), (F.col("m") / own).alias("m_rs"), lam.alias("lam"), fallback.alias("fallback"),
    )


def _plain_pairs(e: DataFrame, fields: dict[str, Column], half_life: int) -> DataFrame:
    """``priced_pairs`` without a partition, by hour: also the columns at and hour.

    What hours before have added to a key stands in the hour as a row before its events, so that each sum is a frame
    within the hour. Events are dealt by hour twice, as they are, and nothing is written in between.
    """
    names = sorted(fields)
    cols = [f"_f{i}" for i in range(len(names))]
    known = e.where("known").select("off", "ent", "at", *(fields[f].cast("string").alias(c) for f, c in zip(names, cols, strict=True))).withColumn("hour", _hour())
    size = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    own, each = weight(F.col("at"), half_life), [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    # kinds of keys: the whole graph, each field's values, each pair of fields' values; and what an event adds
    kinds = [((), size * (size - 1) / 2), *(((i,), size - 1) for i in range(len(names))), *((p, F.lit(1)) for p in each)]
    cells = known.repartition("hour").groupBy("hour", *cols).agg(F.sum(own).alias("w")).where(size >= 2)
    text = lambda c: F.lit(None).cast("string").alias(c)
    there = lambda at: reduce(lambda a, b: a & b, (F.col(cols[i]).isNotNull() for i in at), F.lit(True))
    keys = F.array(*(F.when(there(at), F.struct(F.lit(n).alias("kind"), (F.col("w") * adds).cast("double").alias("add"), *(F.col(c).alias(c) if i in at else text(c) for i, c in enumerate(cols)))) for n, (at, adds) in enumerate(kinds)))
    added = cells.select("hour", F.explode(keys).alias("x")).where("x is not null").select("hour", "x.*").groupBy("hour", "kind", *cols).agg(F.sum("add").alias("add"))
    past = Window.partitionBy("kind", *cols).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = added.withColumn("add", F.sum("add").over(past)).where("add is not null")
    x = known.where(size >= 2).withColumn("kind", F.lit(-1)).unionByName(carried, allowMissingColumns=True).repartition("hour")
    x = x.withColumn("own", own)
    for n, (at, adds) in enumerate(kinds):
        before = Window.partitionBy("hour", *(cols[i] for i in at)).orderBy("at", "off").rowsBetween(Window.unboundedPreceding, -1)  # what is carried has no time, and comes first
        x = x.withColumn(f"_s{n}", F.coalesce(F.sum(F.when(F.col("kind") == n, F.col("add")).when(F.col("kind") < 0, F.col("own") * adds)).over(before), F.lit(0.0)))
    x = x.where("kind < 0")
    number = {at: F.col(f"_s{n}") for n, (at, _) in enumerate(kinds)}
    pair = lambda i, j: F.struct(
        F.lit(names[i]).alias("f_a"), F.col(cols[i]).alias("v_a"), F.lit(names[j]).alias("f_b"), F.col(cols[j]).alias("v_b"), number[i, j].alias("w"), number[(i,)].alias("k_a"), number[(j,)].alias("k_b")
    )
    p = x.select("off", "ent", "at", "hour", "own", number[()].alias("wt"), F.explode(F.array(*(F.when(there((i, j)), pair(i, j)) for i, j in each))).alias("p")).where("p is not null")
    own, null = F.col("own"), lambda c: F.lit(None).cast("double").alias(c)
    lam = F.when(F.col("wt") > 0, F.col("p.k_a") * F.col("p.k_b") / (2 * F.col("wt")) / own).otherwise(0.0)
    return p.select(
        "off", "ent", "p.f_a", "p.v_a", "p.f_b", "p.v_b", *((F.col(f"p.{c}") / own).alias(c) for c in ("w", "k_a", "k_b")), (F.col("wt") / own).alias("total"),
        *map(null, ("d_r", "d_s", "m_rs")), lam.alias("lam"), F.lit(True).alias("fallback"), "at", "hour",
    )


def least_pair(pairs: DataFrame) -> DataFrame:
    """off, ent, tests, f_a, v_a, f_b, v_b, w, lam, fallback, least and log_p: of each event's pairs the one with the least lower tail.

    ``least`` is ln P(Poisson(lam) <= floor(w)); ``log_p`` is it, corrected for the number of pairs. Tails that are equal in nine
    decimals of the logarithm count as tied, and the first pair in the order of fields is taken. A weight that
    misses a whole number by less than 1e-9 counts as it. lam = 0 expects nothing: log_p is 0.
    """
    from ..functions.special import chi2_log_survival

    tail = F.when(F.col("lam") > 0, F.least(F.lit(0.0), chi2_log_survival(2 * F.col("lam"), 2 * (F.floor(F.col("w") + 1e-9) + 1).cast("double")))).otherwise(0.0)
    best = F.struct(F.round("least", 9).alias("key"), *map(F.col, ("f_a", "f_b", "v_a", "v_b", "least", "w", "lam", "fallback")))
    also = [c for c in ("at", "hour") if c in pairs.columns]  # all rows of an hour are in one task already
    x = pairs.withColumn("least", tail).groupBy("off", *also).agg(F.first("ent").alias("ent"), F.count("*").alias("tests"), F.min(best).alias("b"))
    return x.select("off", "ent", "tests", *also, *(f"b.{c}" for c in ("f_a", "v_a", "f_b", "v_b", "w", "lam", "fallback", "least")), sidak_log(F.col("b.least"), F.col("tests")).alias("log_p"))


def snapshot(e: DataFrame, fields: dict[str, Column], half_life: int = HALF_LIFE) -> DataFrame:
    """The whole graph of ``e`` as edges f_a, v_a, f_b, v_b and w, undecayed against each other but for their own times: what a partition is made from."""
    x = nodes_of(e, fields, half_life).where(F.size("nodes") >= 2)
    pair = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = x.select("own", F.explode(pair).alias("p"))
    return p.groupBy(F.col("p.a.field").alias("f_a"), F.col("p.a.value").alias("v_a"), F.col("p.b.field").alias("f_b"), F.col("p.b.value").alias("v_b")).agg(F.sum("own").alias("w"))
