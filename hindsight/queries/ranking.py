"""Alert budgets: ranks by day, arms, unions, entity-days, tallies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import combine as K
from ..plans import conform as C
from ..plans.ranks import numbered
from .base import COMBINED, DAY, HOUR, LABELS, VERDICTS, fused, r6, red, verdicts

#: p-values are ranked after rounding, so that both engines break ties alike.
_ORDER = "round(fisher_p, 9), round(min_p, 9), tm, ent, off"


def _ranked(spark, sf_dir, k):
    f = fused(spark, sf_dir).where(F.col("at") >= C.BURN_IN)
    f = f.withColumn("a", F.round("fisher_p", 9)).withColumn("b", F.round("min_p", 9))
    return K.top_per_day(f, k, ["a", "b", "at", "ent", "off"])


@register("top_alerts_per_day", f"WITH {COMBINED}, r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY {_ORDER}) AS rank FROM f WHERE tm >= {C.BURN_IN}) SELECT d, rank, off, ent, round(fisher_p, 6) AS p FROM r WHERE rank <= 10")
def top_alerts_per_day(spark, sf_dir):
    """The ten most surprising events of each day after burn-in; the plan keeps ten of each day before the shuffle."""
    return _ranked(spark, sf_dir, 10).select("d", F.col("rank").cast("long").alias("rank"), "off", "ent", r6("fisher_p", "p"))


_ARM = f"""arms AS (SELECT detector, off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, p FROM v WHERE tm >= {C.BURN_IN}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY detector, d ORDER BY round(p, 9), tm, ent, off) AS rank FROM arms)"""


def _arms(spark, sf_dir, k):
    v = verdicts(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("d", C.day()).withColumn("a", F.round("p", 9))
    r = F.row_number().over(Window.partitionBy("detector", "d").orderBy("a", "at", "ent", "off"))
    return v.withColumn("rank", r).where(F.col("rank") <= k)


@register("detector_arms", f"WITH {VERDICTS}, {_ARM} SELECT detector, d, rank, off, round(p, 6) AS p FROM ranked WHERE rank <= 5")
def detector_arms(spark, sf_dir):
    return _arms(spark, sf_dir, 5).select("detector", "d", F.col("rank").cast("long").alias("rank"), "off", r6("p", "p"))


def _labels(spark, sf_dir):
    return C.events(spark, sf_dir).select("off", red().cast("int").alias("red"))


@register("detections_at_budget", f"WITH {VERDICTS}, {_ARM}, {LABELS} SELECT detector, b AS budget, count(*) AS alerts, CAST(sum(red) AS BIGINT) AS hits FROM ranked JOIN lab USING (off), (VALUES (10), (25), (50), (100)) AS t(b) WHERE rank <= b GROUP BY 1, 2")
def detections_at_budget(spark, sf_dir):
    x = _arms(spark, sf_dir, 100).join(_labels(spark, sf_dir), "off")
    x = x.select("detector", "rank", "red", F.explode(F.array(*map(F.lit, (10, 25, 50, 100)))).alias("budget")).where("rank <= budget")
    return x.groupBy("detector", "budget").agg(F.count("*").alias("alerts"), F.sum("red").alias("hits"))


@register("union_equal_depth", f"WITH {VERDICTS}, {_ARM} SELECT d, off, min(rank) AS best, count(*) AS carriers FROM ranked WHERE rank <= 20 GROUP BY d, off")
def union_equal_depth(spark, sf_dir):
    """Events in any arm's first twenty of the day: their best rank and how many arms carry them."""
    return _arms(spark, sf_dir, 20).groupBy("d", "off").agg(F.min("rank").cast("long").alias("best"), F.count("*").alias("carriers"))


@register("union_exclusive", f"WITH {VERDICTS}, {_ARM}, u AS (SELECT d, off, count(*) AS c, min(detector) AS one FROM ranked WHERE rank <= 20 GROUP BY d, off) SELECT one AS detector, count(*) AS n FROM u WHERE c = 1 GROUP BY 1")
def union_exclusive(spark, sf_dir):
    u = _arms(spark, sf_dir, 20).groupBy("d", "off").agg(F.count("*").alias("c"), F.min("detector").alias("detector"))
    return u.where("c = 1").groupBy("detector").agg(F.count("*").alias("n"))


@register(
    "union_equal_cost",
    f"WITH {VERDICTS}, {_ARM}, u AS (SELECT d, off, min(rank) AS best FROM ranked WHERE rank <= 50 GROUP BY d, off), q AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY best, off) AS place FROM u) SELECT d, place, off FROM q WHERE place <= 20",
)
def union_equal_cost(spark, sf_dir):
    u = _arms(spark, sf_dir, 50).groupBy("d", "off").agg(F.min("rank").alias("best"))
    return K.top_per_day(u, 20, ["best", "off"]).select("d", F.col("rank").cast("long").alias("place"), "off")


@register(
    "entity_days",
    f"""WITH {COMBINED} SELECT ent, d, count(*) AS n, round(min(ln(fisher_p)) + ln(count(*)), 6) AS min_score, round(sum(-2 * ln(fisher_p)), 6) AS sum_x2, round((sum(-2 * ln(fisher_p)) - 2 * count(*)) / (2 * sqrt(count(*))), 6) AS standard FROM f GROUP BY ent, d""",
)
def entity_days(spark, sf_dir):
    lp = F.log("fisher_p")
    n, x = F.count("*"), F.sum(-2 * lp)
    return fused(spark, sf_dir).groupBy("ent", "d").agg(n.alias("n"), r6(F.min(lp) + F.log(n.cast("double")), "min_score"), r6(x, "sum_x2"), r6((x - 2 * n) / (2 * F.sqrt(n.cast("double"))), "standard"))


@register("p_histogram", f"WITH {VERDICTS} SELECT detector, least(CAST(floor(-log10(p) * 20 + 1e-9) AS BIGINT), 240) AS bin, count(*) AS n FROM v GROUP BY 1, 2")
def p_histogram(spark, sf_dir):
    b = F.least(F.floor(-F.log10("p") * 20 + 1e-9), F.lit(240))
    return verdicts(spark, sf_dir).groupBy("detector", b.alias("bin")).agg(F.count("*").alias("n"))


@register("entity_day_rank", f"WITH {COMBINED}, s AS (SELECT ent, d, round(sum(-2 * ln(fisher_p)), 6) AS score FROM f WHERE tm >= {C.BURN_IN} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ent) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def entity_day_rank(spark, sf_dir):
    s = fused(spark, sf_dir).where(F.col("at") >= C.BURN_IN).groupBy("ent", "d").agg(r6(F.sum(-2 * F.log("fisher_p")), "score"))
    return K.top_per_day(s, 10, [F.desc("score"), "ent"]).select("ent", "d", "score", F.col("rank").cast("long").alias("rank"))


@register("straddlers", f"WITH s AS (SELECT user_id AS ent, count(*) AS n, count(CASE WHEN (epoch_us(ts) // {HOUR}) % 24 IN (22, 23, 0, 1) THEN 1 END) AS night FROM events GROUP BY 1) SELECT ent, n, night, night * 2 >= n AS straddles FROM s")
def straddlers(spark, sf_dir):
    """Entities of whose events half or more fall between 22:00 and 02:00."""
    e = C.events(spark, sf_dir)
    hour = F.pmod(F.floor(F.col("at") / HOUR), F.lit(24))
    s = e.groupBy("ent").agg(F.count("*").alias("n"), F.count(F.when(hour.isin(22, 23, 0, 1), 1)).alias("night"))
    return s.select("ent", "n", "night", (F.col("night") * 2 >= F.col("n")).alias("straddles"))


@register("volume_gate", f"WITH {COMBINED}, ed AS (SELECT ent, d, count(*) AS n, min(fisher_p) AS p FROM f GROUP BY 1, 2) SELECT t AS threshold, count(*) AS kept, round(min(p), 6) AS least FROM ed, (VALUES (0), (1), (2), (3), (5)) AS x(t) WHERE n > t GROUP BY 1")
def volume_gate(spark, sf_dir):
    c = fused(spark, sf_dir).groupBy("ent", "d").agg(F.count("*").alias("n"), F.min("fisher_p").alias("p"))
    c = c.select("n", "p", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 5)))).alias("threshold")).where("n > threshold")
    return c.groupBy("threshold").agg(F.count("*").alias("kept"), r6(F.min("p"), "least"))


@register(
    "routing",
    f"""WITH {COMBINED}, pr AS (SELECT ent, count(*) AS n, count(DISTINCT event_type) AS v, count(DISTINCT CAST(floor(tm / {DAY}.0) AS BIGINT)) AS days FROM e0 WHERE tm < {C.BURN_IN} GROUP BY ent)
SELECT ent, n, v, days, CASE WHEN n >= 50 AND v >= 2 THEN 'noveltyrate' WHEN n >= 20 AND v >= 2 THEN 'novelty' WHEN n >= 20 THEN 'timing' WHEN days >= 8 THEN 'drift' ELSE 'marginal' END AS arm FROM pr""",
)
def routing(spark, sf_dir):
    """The first arm that an entity's burn-in history admits."""
    p = C.events(spark, sf_dir).where(F.col("at") < C.BURN_IN).groupBy("ent").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("v"), F.countDistinct(C.day()).alias("days"))
    n, v = F.col("n"), F.col("v")
    arm = F.when((n >= 50) & (v >= 2), "noveltyrate").when((n >= 20) & (v >= 2), "novelty").when(n >= 20, "timing").when(F.col("days") >= 8, "drift").otherwise("marginal")
    return p.select("ent", "n", "v", "days", arm.alias("arm"))


@register(
    "history_weighting",
    f"""WITH {COMBINED}, h AS (SELECT f.off, fisher_p, count(*) OVER (PARTITION BY ent ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM f), s AS (SELECT *, CAST(floor(ln(1 + n)) AS BIGINT) AS stratum FROM h)
SELECT stratum, count(*) AS n, round(avg(CASE WHEN fisher_p <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY 1""",
)
def history_weighting(spark, sf_dir):
    h = fused(spark, sf_dir).withColumn("n", F.count("*").over(C.before("ent")))
    s = h.withColumn("stratum", F.floor(F.log(1.0 + F.col("n"))))
    return s.groupBy("stratum").agg(F.count("*").alias("n"), r6(F.avg((F.col("fisher_p") <= 0.1).cast("double")), "share"))


@register("canonical_order", f"WITH {VERDICTS} SELECT row_number() OVER (ORDER BY detector, off) AS place, detector, off, ent FROM v")
def canonical_order(spark, sf_dir):
    """All verdicts in canonical order: their places come from ranges of the order, not from one sorted task."""
    v = verdicts(spark, sf_dir).select("detector", "off", "ent")
    return numbered(v, ["detector", "off"], name="place")


@register("optimal_split", f"WITH {VERDICTS}, {_ARM}, {LABELS}, a AS (SELECT detector, rank, sum(red) AS h FROM ranked JOIN lab USING (off) WHERE rank <= 20 GROUP BY 1, 2), c AS (SELECT detector, k, coalesce(sum(h) FILTER (rank <= k), 0) AS h FROM a, range(0, 21) t(k) GROUP BY 1, 2) SELECT x.detector AS a, y.detector AS b, CAST(max(x.h + y.h) AS BIGINT) AS most FROM c x JOIN c y ON x.detector < y.detector AND x.k + y.k = 20 GROUP BY 1, 2")
def optimal_split(spark, sf_dir):
    """For each pair of arms the most labelled events that a split of a daily budget of twenty finds (before overlaps)."""
    a = _arms(spark, sf_dir, 20).join(_labels(spark, sf_dir), "off").groupBy("detector", "rank").agg(F.sum("red").alias("h"))
    c = a.crossJoin(spark.range(21).withColumnRenamed("id", "k")).groupBy("detector", "k").agg(F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("h"))), F.lit(0)).alias("h"))
    x, y = c.select(F.col("detector").alias("a"), F.col("k").alias("ka"), F.col("h").alias("ha")), c.select(F.col("detector").alias("b"), F.col("k").alias("kb"), F.col("h").alias("hb"))
    return x.join(y, (F.col("a") < F.col("b")) & (F.col("ka") + F.col("kb") == 20)).groupBy("a", "b").agg(F.max(F.col("ha") + F.col("hb")).alias("most"))
