"""Evaluation against labels: outcomes, costs, intervals, paired tests, matrices, games."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..plans import conform as C
from .base import COMBINED, LABELS, fused, r6
from .ranking import _ARM, _arms, _labels, _ranked

_TOP = f"r AS (SELECT f.*, red, row_number() OVER (PARTITION BY d ORDER BY round(fisher_p, 9), round(min_p, 9), tm, ent, off) AS rank FROM f JOIN lab USING (off) WHERE tm >= {C.BURN_IN})"


@register(
    "outcomes",
    f"""WITH {COMBINED}, {LABELS}, {_TOP}, b AS (SELECT b AS budget, count(*) AS alerts, CAST(sum(red) AS BIGINT) AS hits FROM r, (VALUES (10), (25), (50), (100)) t(b) WHERE rank <= b GROUP BY 1), n AS (SELECT CAST(sum(red) AS BIGINT) AS labelled, count(*) AS total FROM r)
SELECT budget, alerts, hits, round(hits / alerts, 6) AS precision, round(hits / labelled, 6) AS recall, round((hits / alerts) / (labelled / total), 6) AS lift, round((alerts - hits) / greatest(hits, 1), 6) AS break_even FROM b CROSS JOIN n""",
)
def outcomes(spark, sf_dir):
    x = _ranked(spark, sf_dir, 100).select("rank", F.col("red").cast("long").alias("red"))
    b = x.select("rank", "red", F.explode(F.array(*map(F.lit, (10, 25, 50, 100)))).alias("budget")).where("rank <= budget").groupBy("budget").agg(F.count("*").alias("alerts"), F.sum("red").alias("hits"))
    n = fused(spark, sf_dir).where(F.col("at") >= C.BURN_IN).agg(F.sum(F.col("red").cast("long")).alias("labelled"), F.count("*").alias("total"))
    p = F.col("hits") / F.col("alerts")
    return b.crossJoin(F.broadcast(n)).select("budget", "alerts", "hits", r6(p, "precision"), r6(F.col("hits") / F.col("labelled"), "recall"), r6(p / (F.col("labelled") / F.col("total")), "lift"), r6((F.col("alerts") - F.col("hits")) / F.greatest("hits", F.lit(1)), "break_even"))


@register(
    "optimal_cutoff",
    f"""WITH {COMBINED}, {LABELS}, {_TOP}, p AS (SELECT row_number() OVER (ORDER BY round(fisher_p, 9), off) AS n, red FROM r WHERE rank <= 50), cc AS (SELECT n, sum(red) OVER (ORDER BY n) AS tp FROM p), u AS (SELECT n, tp, 20 * tp - (n - tp) AS utility FROM cc)
SELECT CAST(n AS BIGINT) AS depth, CAST(tp AS BIGINT) AS hits, CAST(utility AS BIGINT) AS utility FROM u ORDER BY utility DESC, n LIMIT 1""",
)
def optimal_cutoff(spark, sf_dir):
    """The depth of the pooled daily lists (fifty of each day) at which 20 per hit less 1 per false alert is greatest."""
    x = _ranked(spark, sf_dir, 50).select("off", F.round("fisher_p", 9).alias("p"), F.col("red").cast("long").alias("red"))
    w = Window.orderBy("p", "off")
    c = x.select(F.row_number().over(w).alias("depth"), F.sum("red").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    c = c.withColumn("utility", 20 * F.col("hits") - (F.col("depth") - F.col("hits")))
    return c.agg(F.max(F.struct("utility", (-F.col("depth")).alias("minus"), "hits")).alias("b")).select((-F.col("b.minus")).cast("long").alias("depth"), F.col("b.hits").alias("hits"), F.col("b.utility").alias("utility"))


_RATES = "(VALUES (1.0), (5.0), (10.0), (20.0), (50.0)) t(ratio)"


@register("cost_curve", f"WITH {COMBINED}, {LABELS}, {_TOP}, k AS (SELECT rank, count(*) AS n, sum(red) AS h FROM r WHERE rank <= 50 GROUP BY 1), cc AS (SELECT rank, sum(n) OVER (ORDER BY rank) AS alerts, sum(h) OVER (ORDER BY rank) AS hits FROM k) SELECT CAST(t.ratio AS DOUBLE) AS ratio, CAST(max(t.ratio * hits - (alerts - hits)) AS DOUBLE) AS utility, round(1 / (1 + t.ratio), 6) AS threshold FROM cc, {_RATES} GROUP BY t.ratio")
def cost_curve(spark, sf_dir):
    """For each worth of a hit in false alerts the best utility over daily budgets, and the posterior at which an alert pays."""
    k = _ranked(spark, sf_dir, 50).groupBy("rank").agg(F.count("*").alias("n"), F.sum(F.col("red").cast("long")).alias("h"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most 50 rows
    c = k.select(F.sum("n").over(w).alias("alerts"), F.sum("h").over(w).alias("hits"))
    x = c.select("*", F.explode(F.array(*map(F.lit, (1.0, 5.0, 10.0, 20.0, 50.0)))).alias("ratio"))
    return x.groupBy("ratio").agg(F.max(F.col("ratio") * F.col("hits") - (F.col("alerts") - F.col("hits"))).alias("utility")).select("ratio", "utility", r6(1 / (1 + F.col("ratio")), "threshold"))


@register(
    "wilson_intervals",
    "WITH x AS (SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), y AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM x) SELECT lang, n, k, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 6) AS low, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 6) AS high FROM y",
)
def wilson_intervals(spark, sf_dir):
    x = C.read(spark, sf_dir, "documents").join(C.read(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return x.select("lang", "n", "k", r6(low, "low"), r6(high, "high"))


@register("exact_intervals")
def exact_intervals(spark, sf_dir):
    """Clopper-Pearson bounds of the toxic share by language (a handful of rows)."""
    from ..functions.special import clopper_pearson

    x = C.read(spark, sf_dir, "documents").join(C.read(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()
    rows = [(r["lang"], r["n"], r["k"], *(round(v, 6) for v in clopper_pearson(r["k"], r["n"]))) for r in x]
    return spark.createDataFrame(rows, "lang string, n long, k long, low double, high double")


@register(
    "mcnemar_counts",
    f"""WITH {COMBINED}, {LABELS}, {_ARM}, a AS (SELECT off, max(CASE WHEN detector = 'novelty_k' THEN 1 ELSE 0 END) AS x, max(CASE WHEN detector = 'novelty_band' THEN 1 ELSE 0 END) AS y FROM ranked WHERE rank <= 50 GROUP BY off)
SELECT count(CASE WHEN x = 1 AND coalesce(y, 0) = 0 THEN 1 END) AS first_only, count(CASE WHEN coalesce(x, 0) = 0 AND y = 1 THEN 1 END) AS second_only FROM a JOIN lab USING (off) WHERE red = 1""",
)
def mcnemar_counts(spark, sf_dir):
    """Labelled events that one of two arms finds and the other does not."""
    a = _arms(spark, sf_dir, 50).join(_labels(spark, sf_dir), "off").where("red = 1").groupBy("off").agg(F.max((F.col("detector") == "novelty_k").cast("int")).alias("x"), F.max((F.col("detector") == "novelty_band").cast("int")).alias("y"))
    return a.agg(F.count(F.when((F.col("x") == 1) & (F.col("y") == 0), 1)).alias("first_only"), F.count(F.when((F.col("x") == 0) & (F.col("y") == 1), 1)).alias("second_only"))


@register("mcnemar_test")
def mcnemar_test(spark, sf_dir):
    from ..functions.special import mcnemar

    r = mcnemar_counts(spark, sf_dir).first()
    return spark.createDataFrame([(r[0], r[1], round(mcnemar(r[0], r[1]), 9))], "first_only long, second_only long, p double")


@register("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """Seeded resamples of the difference in labelled events found per day: 2.5 %, 50 % and 97.5 %. Days are few; the draws run in tasks."""
    from ..functions.special import splitmix64

    x = _arms(spark, sf_dir, 50).join(_labels(spark, sf_dir), "off").groupBy("d").agg(F.sum(F.when(F.col("detector") == "novelty_k", F.col("red")).otherwise(0)).alias("a"), F.sum(F.when(F.col("detector") == "novelty_band", F.col("red")).otherwise(0)).alias("b"))
    days = [r["a"] - r["b"] for r in x.orderBy("d").collect()]

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for i in f["id"]:
                state, s = int(i) * 7919 + 1, 0
                for _ in days:
                    state, v = splitmix64(state)
                    s += days[v % len(days)]
                out.append(float(s))
            yield pd.DataFrame({"delta": out})

    d = spark.range(2000).mapInPandas(run, "delta double")
    return d.agg(F.expr("percentile(delta, 0.025)").alias("low"), F.expr("percentile(delta, 0.5)").alias("middle"), F.expr("percentile(delta, 0.975)").alias("high"))


_MATRIX = "sum(red) FILTER (band = 'low') AS low, sum(red) FILTER (band = 'mid') AS mid, sum(red) FILTER (band = 'high') AS high"


@register(
    "method_matrix",
    f"""WITH {COMBINED}, {LABELS}, {_ARM}, m AS (SELECT detector, CASE WHEN value < 75 THEN 'low' WHEN value < 90 THEN 'mid' ELSE 'high' END AS band, red FROM ranked JOIN lab USING (off) JOIN (SELECT off, value FROM e0) USING (off) WHERE rank <= 50)
SELECT detector, CAST(coalesce(sum(red) FILTER (band = 'low'), 0) AS BIGINT) AS low, CAST(coalesce(sum(red) FILTER (band = 'mid'), 0) AS BIGINT) AS mid, CAST(coalesce(sum(red) FILTER (band = 'high'), 0) AS BIGINT) AS high FROM m GROUP BY 1""",
)
def method_matrix(spark, sf_dir):
    """Labelled events found by each arm at fifty a day, by mechanism (three bands of the value)."""
    v = F.col("value")
    m = _arms(spark, sf_dir, 50).join(_labels(spark, sf_dir), "off").join(C.events(spark, sf_dir).select("off", "value"), "off")
    m = m.withColumn("mechanism", F.when(v < 75, "low").when(v < 90, "mid").otherwise("high"))
    p = m.groupBy("detector").pivot("mechanism", ["low", "mid", "high"]).agg(F.sum("red"))
    return p.select("detector", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("low", "mid", "high")))


@register("robust_allocation")
def robust_allocation(spark, sf_dir):
    """The mix of arms whose worst mechanism keeps most of its best arm's detections: a game solved by the simplex method on a few numbers."""
    import numpy as np

    from ..operators.decide import competitive_ratio

    rows = method_matrix(spark, sf_dir).orderBy("detector").collect()
    value, mix = competitive_ratio(np.array([[r["low"], r["mid"], r["high"]] for r in rows], float))
    return spark.createDataFrame([(r["detector"], round(float(w), 6), round(float(value), 6)) for r, w in zip(rows, mix, strict=True)], "detector string, share double, ratio double")


@register(
    "mutual_information",
    """WITH x AS (SELECT event_type AS a, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS b FROM events), n AS (SELECT count(*) AS n FROM x), j AS (SELECT a, b, count(*) AS c FROM x GROUP BY 1, 2), p AS (SELECT a, count(*) AS ca FROM x GROUP BY 1), q AS (SELECT b, count(*) AS cb FROM x GROUP BY 1)
SELECT round(sum(c / n * ln(c * n / (CAST(ca AS DOUBLE) * cb))), 6) AS mi FROM j JOIN p USING (a) JOIN q USING (b) CROSS JOIN n""",
)
def mutual_information(spark, sf_dir):
    x = C.events(spark, sf_dir).select(F.col("event_type").alias("a"), F.floor(F.col("k").cast("int") / 10).alias("b"))
    j = x.groupBy("a", "b").agg(F.count("*").alias("c"))  # marginals follow from the joint counts
    j = j.withColumn("ca", F.sum("c").over(Window.partitionBy("a"))).withColumn("cb", F.sum("c").over(Window.partitionBy("b")))
    total = j.agg(F.sum("c").alias("n"))
    return j.crossJoin(F.broadcast(total)).agg(r6(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca").cast("double") * F.col("cb")))), "mi"))


@register(
    "realised_fdr",
    f"""WITH {COMBINED}, {LABELS}, {_TOP}, t AS (SELECT *, count(*) OVER (PARTITION BY d) AS m FROM r), q AS (SELECT q, d, red, rank, max(CASE WHEN round(fisher_p, 9) <= rank * q / m THEN rank END) OVER (PARTITION BY q, d) AS k FROM t, (VALUES (0.1), (0.2), (0.5)) v(q))
SELECT CAST(q AS DOUBLE) AS q, count(CASE WHEN rank <= k THEN 1 END) AS rejected, CAST(coalesce(sum(CASE WHEN rank <= k THEN 1 - red END), 0) AS BIGINT) AS false_alerts FROM q GROUP BY 1""",
)
def realised_fdr(spark, sf_dir):
    f = fused(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("p", F.round("fisher_p", 9)).withColumn("b", F.round("min_p", 9))
    w = Window.partitionBy("d")
    t = f.select("d", "p", F.col("red").cast("int").alias("red"), F.row_number().over(w.orderBy("p", "b", "at", "ent", "off")).alias("rank"), F.count("*").over(w).alias("m"))
    t = t.select("*", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5)))).alias("q"))
    t = t.withColumn("k", F.max(F.when(F.col("p") <= F.col("rank") * F.col("q") / F.col("m"), F.col("rank"))).over(Window.partitionBy("q", "d")))
    hit = F.col("rank") <= F.col("k")
    return t.groupBy("q").agg(F.count(F.when(hit, 1)).alias("rejected"), F.coalesce(F.sum(F.when(hit, 1 - F.col("red"))), F.lit(0)).alias("false_alerts"))


@register("gap_to_cut", f"WITH {COMBINED}, {LABELS}, {_TOP}, cc AS (SELECT d, max(CASE WHEN rank = 20 THEN round(fisher_p, 9) END) AS cut FROM r GROUP BY d) SELECT off, rank, round(ln(round(fisher_p, 9) / cut), 5) AS gap FROM r JOIN cc USING (d) WHERE red = 1")
def gap_to_cut(spark, sf_dir):
    """How far, in log p, each labelled event lies from its day's twentieth."""
    f = fused(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("p", F.round("fisher_p", 9)).withColumn("b", F.round("min_p", 9))
    w = Window.partitionBy("d")
    r = f.withColumn("rank", F.row_number().over(w.orderBy("p", "b", "at", "ent", "off")))
    r = r.withColumn("cut", F.max(F.when(F.col("rank") == 20, F.col("p"))).over(w))
    return r.where("red").select("off", F.col("rank").cast("long").alias("rank"), F.round(F.log(F.col("p") / F.col("cut")), 5).alias("gap"))
