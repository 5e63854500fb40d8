"""Combination, calibration and multiple testing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import combine as K
from ..operators import online as O
from ..plans import conform as C
from .base import COMBINED, DAY, VERDICTS, fused, r6, red, verdicts


@register("fisher_combination", f"WITH {COMBINED} SELECT off, ent, j, round(x2, 6) AS x2, round(fisher_p, 6) AS fisher_p FROM f")
def fisher_combination(spark, sf_dir):
    return fused(spark, sf_dir).select("off", "ent", "j", r6("x2", "x2"), r6("fisher_p", "fisher_p"))


@register("min_p_sidak", f"WITH {COMBINED}, a AS (SELECT off, min((round(p, 9), detector)) AS b FROM v GROUP BY off) SELECT off, j, b[2] AS min_detector, round(min_p, 6) AS min_p, round(minp_p, 6) AS p FROM f JOIN a USING (off)")
def min_p_sidak(spark, sf_dir):
    return fused(spark, sf_dir).select("off", "j", "min_detector", r6("min_p", "min_p"), r6("minp_p", "p"))


@register(
    "detector_correlations",
    f"""WITH {VERDICTS} SELECT a.detector AS a, b.detector AS b, count(*) AS n, round(corr(-2 * ln(a.p), -2 * ln(b.p)), 6) AS rho, round(covar_samp(-2 * ln(a.p), -2 * ln(b.p)), 6) AS covariance
FROM v a JOIN v b ON a.off = b.off AND a.detector < b.detector GROUP BY 1, 2""",
)
def detector_correlations(spark, sf_dir):
    return K.correlations(verdicts(spark, sf_dir)).select("a", "b", "n", r6("rho", "rho"), r6("covariance", "covariance"))


@register(
    "brown_scale",
    f"""WITH {VERDICTS}, c AS (SELECT sum(s) AS s FROM (SELECT covar_samp(-2 * ln(a.p), -2 * ln(b.p)) AS s FROM v a JOIN v b ON a.off = b.off AND a.detector < b.detector GROUP BY a.detector, b.detector))
SELECT 3 AS j, round((12 + 2 * s) / 12, 6) AS scale, round(72 / (12 + 2 * s), 6) AS dof FROM c""",
)
def brown_scale(spark, sf_dir):
    """Scale and degrees of freedom of the sum of three correlated -2 ln p: mean 2 j, variance 4 j + 2 sum of covariances."""
    s = K.correlations(verdicts(spark, sf_dir)).agg(F.sum("covariance").alias("s"))
    scale, dof = K.brown(F.lit(6.0), 12 + 2 * F.col("s"))
    return s.select(F.lit(3).alias("j"), r6(scale, "scale"), r6(dof, "dof"))


@register("brown_combination")
def brown_combination(spark, sf_dir):
    """Fisher's sum against the scaled chi-square; a real number of degrees needs the incomplete gamma function."""
    from ..functions.special import chi2_log_survival

    f = fused(spark, sf_dir).where("j = 3")
    s = K.correlations(verdicts(spark, sf_dir)).agg(F.sum("covariance").alias("s"))
    scale, dof = K.brown(F.lit(6.0), 12 + 2 * F.col("s"))
    x = f.crossJoin(F.broadcast(s.select(scale.alias("scale"), dof.alias("dof"))))  # one row
    return x.select("off", r6(chi2_log_survival(F.col("x2") / F.col("scale"), F.col("dof")), "log_p"))


@register(
    "brown_diagnostic",
    f"""WITH {COMBINED} SELECT d, j, count(*) AS n, round(avg(x2), 6) AS mean_x2, CASE WHEN count(*) >= 100 THEN round(var_samp(x2), 5) END AS var_x2, CAST(2 * j AS BIGINT) AS predicted_mean, CAST(4 * j AS BIGINT) AS predicted_var FROM f GROUP BY d, j""",
)
def brown_diagnostic(spark, sf_dir):
    x = fused(spark, sf_dir).groupBy("d", "j").agg(F.count("*").alias("n"), F.avg("x2").alias("m"), F.var_samp("x2").alias("s"))
    return x.select("d", "j", "n", r6("m", "mean_x2"), F.when(F.col("n") >= 100, F.round("s", 5)).alias("var_x2"), (2 * F.col("j")).alias("predicted_mean"), (4 * F.col("j")).alias("predicted_var"))


@register(
    "conformal",
    f"""WITH {VERDICTS}, b AS (SELECT *, least(CAST(floor(-ln(p) / 0.25) AS BIGINT), 16384) AS bin FROM v), past AS (SELECT detector, bin FROM b WHERE tm < {C.BURN_IN}), n AS (SELECT detector, count(*) AS n FROM past GROUP BY 1),
h AS (SELECT detector, bin, count(*) AS c FROM past GROUP BY 1, 2), g AS (SELECT DISTINCT detector, bin FROM b WHERE tm >= {C.BURN_IN}), ge AS (SELECT g.detector, g.bin, sum(c) AS ge FROM g JOIN h ON h.detector = g.detector AND h.bin >= g.bin GROUP BY 1, 2)
SELECT off, b.detector, round(p, 6) AS p, round(CASE WHEN n >= 200 THEN (1 + coalesce(ge, 0)) / (n + 1) END, 6) AS q FROM b JOIN n USING (detector) LEFT JOIN ge USING (detector, bin) WHERE tm >= {C.BURN_IN}""",
)
def conformal(spark, sf_dir):
    return K.conformal(verdicts(spark, sf_dir), F.col("at") < C.BURN_IN).select("off", "detector", r6("p", "p"), r6("q", "q"))


def _step_up(name, factor, dependence):
    @register(
        name,
        f"""WITH {COMBINED}, r AS (SELECT off, d, fisher_p, row_number() OVER (PARTITION BY d ORDER BY round(fisher_p, 9), off) AS r, count(*) OVER (PARTITION BY d) AS m FROM f),
k AS (SELECT *, max(CASE WHEN round(fisher_p, 9) <= r * 0.2 / (m * {factor}) THEN r END) OVER (PARTITION BY d) AS k FROM r) SELECT off, d, round(fisher_p, 6) AS p, coalesce(r <= k, false) AS rejected FROM k""",
    )
    def run(spark, sf_dir):
        x = fused(spark, sf_dir).select("off", "d", F.round("fisher_p", 9).alias("q"), "fisher_p")
        return K.step_up(x, "d", "q", 0.2, dependence).select("off", "d", r6("fisher_p", "p"), "rejected")


_step_up("benjamini_hochberg", "1.0", False)
_step_up("benjamini_yekutieli", "list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i))", True)


@register(
    "storey_weights",
    f"""WITH {COMBINED}, s AS (SELECT ntile(4) OVER (ORDER BY x.value, f.off) AS stratum, fisher_p FROM f JOIN e0 x USING (off))
SELECT stratum, count(*) AS n, round(least(1.0, (1 + count(CASE WHEN fisher_p > 0.5 THEN 1 END)) / (count(*) * 0.5)), 6) AS pi0, round((1 - least(1.0, (1 + count(CASE WHEN fisher_p > 0.5 THEN 1 END)) / (count(*) * 0.5))) / least(1.0, (1 + count(CASE WHEN fisher_p > 0.5 THEN 1 END)) / (count(*) * 0.5)), 6) AS weight FROM s GROUP BY 1""",
)
def storey_weights(spark, sf_dir):
    x = fused(spark, sf_dir).join(C.events(spark, sf_dir).select("off", "value"), "off")
    return K.storey_weights(x, "value", "fisher_p").select("stratum", "n", r6("pi0", "pi0"), r6("weight", "weight"))


@register(
    "weighted_bh",
    f"""WITH {COMBINED}, w AS (SELECT f.off, d, fisher_p, CASE WHEN event_type = 'error' THEN 2.0 WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END AS w FROM f JOIN e0 USING (off)),
q AS (SELECT *, CASE WHEN w > 0 THEN round(fisher_p * avg(w) OVER (PARTITION BY d) / w, 9) ELSE CAST('inf' AS DOUBLE) END AS q FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY q, off) AS r, count(*) OVER (PARTITION BY d) AS m FROM q),
k AS (SELECT *, max(CASE WHEN q <= r * 0.2 / m THEN r END) OVER (PARTITION BY d) AS k FROM r) SELECT off, d, coalesce(r <= k, false) AS rejected FROM k""",
)
def weighted_bh(spark, sf_dir):
    x = fused(spark, sf_dir).join(C.events(spark, sf_dir).select("off", "event_type"), "off")
    x = x.withColumn("w", F.when(F.col("event_type") == "error", 2.0).when(F.col("event_type") == "view", 0.0).otherwise(1.0))
    return K.weighted_step_up(x, "d", "fisher_p", "w", 0.2).select("off", "d", "rejected")


@register(
    "cross_fitted_bh",
    f"""WITH {COMBINED}, s AS (SELECT f.off, d, fisher_p AS p, ntile(4) OVER (ORDER BY x.value, f.off) AS stratum, ((CAST(f.off AS UHUGEINT) + 1 + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z0 FROM f JOIN e0 x USING (off)),
s1 AS (SELECT *, (xor(z0, z0 >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS z1 FROM s), s2 AS (SELECT *, (xor(z1, z1 >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS z2 FROM s1),
s3 AS (SELECT off, d, p, stratum, CAST(xor(z2, z2 >> 31::UHUGEINT) % 5::UHUGEINT AS INTEGER) AS fold FROM s2),
l AS (SELECT stratum, f.fold, least(1.0, (1 + count(CASE WHEN p > 0.5 THEN 1 END)) / (count(*) * 0.5)) AS pi0 FROM s3, range(5) f(fold) WHERE s3.fold <> f.fold GROUP BY 1, 2),
g AS (SELECT stratum, fold, CASE WHEN max((1 - pi0) / pi0) OVER (PARTITION BY fold) <= 0 THEN 1.0 ELSE (1 - pi0) / pi0 END AS w FROM l), w AS (SELECT s3.*, coalesce(w, 1.0) AS w FROM s3 LEFT JOIN g USING (stratum, fold)),
q AS (SELECT *, CASE WHEN w > 0 THEN round(p * avg(w) OVER (PARTITION BY d) / w, 9) ELSE CAST('inf' AS DOUBLE) END AS q FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY q, off) AS r, count(*) OVER (PARTITION BY d) AS m FROM q),
k AS (SELECT *, max(CASE WHEN q <= r * 0.2 / m THEN r END) OVER (PARTITION BY d) AS k FROM r) SELECT off, d, stratum, fold, round(w, 6) AS weight, coalesce(r <= k, false) AS rejected FROM k""",
)
def cross_fitted_bh(spark, sf_dir):
    """Weighted Benjamini-Hochberg by day, with weights by strata of the event's value that each fold takes from the others."""
    x = fused(spark, sf_dir).join(C.events(spark, sf_dir).select("off", "value"), "off")
    w = K.cross_fitted_weights(x, "value", "fisher_p")
    return K.weighted_step_up(w, "d", "fisher_p", "weight", 0.2).select("off", "d", "stratum", "fold", r6("weight", "weight"), "rejected")


@register(
    "higher_criticism",
    f"""WITH {COMBINED}, r AS (SELECT d, fisher_p AS p, row_number() OVER (PARTITION BY d ORDER BY fisher_p, off) AS i, count(*) OVER (PARTITION BY d) AS n FROM f),
x AS (SELECT *, CASE WHEN i <= greatest(floor(0.5 * n), 1) AND p > 0 AND p < 1 THEN sqrt(n) * (i / n - p) / sqrt(p * (1 - p)) END AS v FROM r)
SELECT d, max(n) AS n, round(max(v), 5) AS hc, round(max(CASE WHEN i <= 32 THEN v END), 5) AS hc_tail, greatest(floor(0.5 * max(n)), 1) > 32 AS truncated FROM x GROUP BY d""",
)
def higher_criticism(spark, sf_dir):
    """By day over the whole first half of its p-values, and over the 32 smallest, which a bounded summary would hold."""
    x = K.higher_criticism(fused(spark, sf_dir).select("off", "d", F.col("fisher_p").alias("p")), "d", "p")
    return x.select("d", "n", F.round("hc", 5).alias("hc"), F.round("hc_tail", 5).alias("hc_tail"), "truncated")


@register("lord_online")
def lord_online(spark, sf_dir):
    """LORD++ over the ordered stream of Fisher p-values, in blocks whose levels are found by parallel passes."""
    return O.lord(fused(spark, sf_dir), "fisher_p").select("off", "test", r6(F.col("level") * 1e6, "level_ppm"), "rejected")


@register("online_daily")
def online_daily(spark, sf_dir):
    """By day: tests, rejections, labelled events among them, the day's mean level, and the wealth spent so far."""
    x = O.lord(fused(spark, sf_dir), "fisher_p").join(C.events(spark, sf_dir).select("off", red().cast("int").alias("red")), "off").withColumn("d", C.day())
    g = x.groupBy("d").agg(F.count("*").alias("tests"), F.count_if("rejected").alias("rejections"), F.count_if(F.col("rejected") & (F.col("red") == 1)).alias("hits"), F.sum("level").alias("spent"))
    so_far = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return g.select("d", "tests", "rejections", "hits", r6(F.col("spent") / F.col("tests") * 1e6, "mean_level_ppm"), r6(F.sum("spent").over(so_far), "spent"))


@register(
    "composite_conformal",
    f"""WITH {COMBINED}, b AS (SELECT off, tm, fisher_p, least(CAST(floor(-ln(fisher_p) / 0.25) AS BIGINT), 16384) AS bin FROM f),
p AS (SELECT bin FROM b WHERE tm >= {C.ORIGIN + 7 * DAY} AND tm < {C.BURN_IN}), h AS (SELECT bin, count(*) AS c FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM p), g AS (SELECT x.bin, sum(c) AS ge FROM (SELECT DISTINCT bin FROM b) x JOIN h ON h.bin >= x.bin GROUP BY 1)
SELECT off, round((1 + coalesce(ge, 0)) / (n + 1), 6) AS q FROM b CROSS JOIN n LEFT JOIN g USING (bin) WHERE tm >= {C.BURN_IN}""",
)
def composite_conformal(spark, sf_dir):
    """Fisher's combined p against the second half of the burn-in."""
    f = fused(spark, sf_dir).where(F.col("at") >= C.ORIGIN + 7 * DAY).select("off", "at", F.lit("fisher").alias("detector"), F.col("fisher_p").alias("p"))
    return K.conformal(f, F.col("at") < C.BURN_IN, least=1).select("off", r6("q", "q"))
