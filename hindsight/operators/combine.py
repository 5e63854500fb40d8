"""Combination of verdicts, conformal calibration and multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fisher_tail, sidak
from ..plans.ranks import numbered, prefix


def combined(v: DataFrame) -> DataFrame:
    """off, j, x2, fisher_p, min_p and minp_p of each event's evaluated verdicts (off, detector, p)."""
    one = v.groupBy("off").agg(F.count("*").alias("j"), F.sum(-2 * F.log("p")).alias("x2"), F.min("p").alias("min_p"), F.min(F.struct(F.round("p", 9).alias("p"), "detector")).getField("detector").alias("min_detector"))
    return one.withColumn("fisher_p", fisher_tail(F.col("x2"), F.col("j"))).withColumn("minp_p", sidak(F.col("min_p"), F.col("j")))


def brown(mean: Column, variance: Column) -> tuple[Column, Column]:
    """Scale and degrees of freedom that match a sum's mean and variance."""
    return variance / (2 * mean), 2 * mean * mean / variance


def kost(rho: Column) -> Column:
    """Covariance of two -2 ln p at a correlation (fixed coefficients)."""
    return 3.263 * rho + 0.710 * rho * rho + 0.027 * rho * rho * rho


def correlations(v: DataFrame) -> DataFrame:
    """a, b, n, rho and covariance of -2 ln p for pairs of detectors that judged the same event.

    Per event the detectors' values become columns, so a pair of detectors is an aggregate, not a join.
    """
    names = sorted(r[0] for r in v.select("detector").distinct().collect())
    wide = v.groupBy("off").pivot("detector", names).agg(F.max(-2 * F.log("p")))
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x).alias("n"), F.corr(x, y).alias("rho"), F.covar_samp(x, y).alias("covariance")))
    return wide.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


WIDTH = 0.25
MOST_BINS = 16_384


def bin_of(p: Column) -> Column:
    return F.least(F.floor(-F.log(p) / WIDTH).cast("long"), F.lit(MOST_BINS))


def conformal(v: DataFrame, burn_in: Column, least: int = 200) -> DataFrame:
    """off, detector, p and q: after burn-in each p against the detector's own burn-in, (1 + as extreme) / (n + 1).

    The table of bins has at most 16,385 rows a detector; it is joined by bin.
    """
    past = v.where(burn_in).groupBy("detector", bin_of(F.col("p")).alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("detector")
    up = w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    table = past.select("detector", "bin", F.sum("c").over(up).alias("ge"), F.sum("c").over(w).alias("n"), F.lead("bin").over(w.orderBy(F.desc("bin"))).alias("below"))
    now = v.where(~burn_in).withColumn("bin", bin_of(F.col("p")))
    total = table.groupBy("detector").agg(F.max("n").alias("n"))
    hit = table.select("detector", F.col("bin").alias("top"), F.coalesce(F.col("below") + 1, F.lit(0)).alias("low"), "ge")
    spread = hit.select("detector", "ge", F.explode(F.sequence("low", "top")).alias("bin"))
    out = now.join(total, "detector").join(F.broadcast(spread), ["detector", "bin"], "left")
    return out.select("off", "detector", "p", F.when(F.col("n") >= least, (1 + F.coalesce("ge", F.lit(0))) / (F.col("n") + 1)).alias("q"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; from 64 on by its expansion, whose error is below a double's."""
    x = m.cast("double")
    short = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(m <= 64, short).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def step_up(t: DataFrame, group: str, p: str, level: float, arbitrary_dependence: bool = False) -> DataFrame:
    """``t`` with ``rejected``: Benjamini-Hochberg in each group, or Benjamini-Yekutieli.

    What is rejected are the p up to the largest that is no larger than its rank's share of the level. Equal p
    stand or fall together, so they are counted first, and the counts are summed over ranges of p: no group is one task's work.
    """
    known = t.where(F.col(p).isNotNull())
    counts = known.groupBy(group, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    totals = known.groupBy(group).agg(F.count("*").alias("_m"))
    ranked = prefix(counts, [group], ["_p"], {"_r": F.col("_c")}).join(totals, group)
    factor = harmonic(F.col("_m")) if arbitrary_dependence else F.lit(1.0)
    last = ranked.where(F.col("_p") <= F.col("_r") * level / (F.col("_m") * factor)).groupBy(group).agg(F.max("_p").alias("_last"))
    return t.join(last, group, "left").withColumn("rejected", F.coalesce(F.col(p) <= F.col("_last"), F.lit(False))).drop("_last")


def weighted_step_up(t: DataFrame, group: str, p: str, weight: str, level: float) -> DataFrame:
    """Benjamini-Hochberg on p over weights of mean 1, rounded to 9 digits; weight 0 never rejects."""
    mean = t.groupBy(group).agg(F.avg(weight).alias("_mean"))
    q = F.when(F.col(weight) > 0, F.round(F.col(p) * F.col("_mean") / F.col(weight), 9)).otherwise(F.lit(float("inf")))
    return step_up(t.join(mean, group).withColumn("_q", q), group, "_q", level).drop("_q", "_mean")


def strata(t: DataFrame, covariate: str, n: int = 4) -> DataFrame:
    """``t`` with ``stratum`` 1 to n: parts of equal count in the order of a covariate, the first ones larger by one where it does not divide."""
    x = numbered(t, [covariate, "off"], name="_i")
    m = t.agg(F.count("*").alias("_m"))
    x = x.crossJoin(F.broadcast(m))  # a single row
    small, longer = F.floor(F.col("_m") / n), F.col("_m") % n
    edge = longer * (small + 1)
    place = F.when(F.col("_i") <= edge, F.floor((F.col("_i") - 1) / (small + 1)) + 1).otherwise(longer + F.floor((F.col("_i") - 1 - edge) / F.greatest(small, F.lit(1))) + 1)
    return x.withColumn("stratum", place.cast("int")).drop("_i", "_m")


def null_share(n: Column, above: Column, lam: float = 0.5) -> Column:
    """Storey's share of true nulls among n tests of which ``above`` have p over lam; at most 1."""
    return F.least(F.lit(1.0), (1 + above) / (n * (1 - lam)))


def storey_weights(t: DataFrame, covariate: str, p: str, n: int = 4, lam: float = 0.5) -> DataFrame:
    """stratum, n, pi0 and weight (1 - pi0) / pi0 over equal-count strata of a covariate."""
    pi0 = null_share(F.count("*"), F.sum((F.col(p) > lam).cast("long")), lam)
    return strata(t, covariate, n).groupBy("stratum").agg(F.count("*").alias("n"), pi0.alias("pi0")).withColumn("weight", (1 - F.col("pi0")) / F.col("pi0"))


def cross_fitted_weights(t: DataFrame, covariate: str, p: str, n: int = 4, folds: int = 5, lam: float = 0.5, seed: int = 1) -> DataFrame:
    """``t`` with stratum, fold and weight: a test's weight is learned from the tests of its stratum in all folds but its own.

    Folds come from a hash of seed and ``off`` alone. Counts by stratum and fold are all that is gathered; where each
    weight of a fold is zero, its weights are 1. Bring them to mean 1 with ``weighted_step_up``.
    """
    from ..functions.special import splitmix_fold

    x = strata(t, covariate, n).withColumn("fold", splitmix_fold(F.col("off"), F.lit(seed), F.lit(folds)))
    cells = x.groupBy("stratum", "fold").agg(F.count("*").alias("c"), F.sum((F.col(p) > lam).cast("long")).alias("h"))  # strata x folds rows
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    rest = cells.withColumnRenamed("fold", "of").withColumn("fold", fold).where("of <> fold").groupBy("stratum", "fold").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    pi0 = null_share(F.col("c"), F.col("h"), lam)
    learned = rest.select("stratum", "fold", ((1 - pi0) / pi0).alias("weight"))
    flat = learned.groupBy("fold").agg((F.max("weight") <= 0).alias("flat"))
    learned = learned.join(flat, "fold").select("stratum", "fold", F.when(F.col("flat"), 1.0).otherwise(F.col("weight")).alias("weight"))
    # a stratum that lies in one fold only has nothing to learn from
    return x.join(F.broadcast(learned), ["stratum", "fold"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def higher_criticism(t: DataFrame, group: str, p: str, alpha0: float = 0.5, tail: int = 32) -> DataFrame:
    """group, n, hc, hc_tail and truncated: the largest standardised excess of small p over the first alpha0 n.

    ``hc_tail`` looks at the ``tail`` smallest only, as a bounded summary would; ``truncated`` says that this leaves some of them out.
    """
    counts = t.groupBy(group).agg(F.count("*").alias("n"))
    most = F.greatest(F.floor(alpha0 * F.col("n")), F.lit(1))
    x = numbered(t.select(group, F.col(p).alias("p"), "off"), ["p", "off"], [group], "i").join(counts, group)
    value = F.sqrt(F.col("n").cast("double")) * (F.col("i") / F.col("n") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")))
    inside = (F.col("i") <= most) & (F.col("p") > 0) & (F.col("p") < 1)
    found = x.groupBy(group).agg(F.max("n").alias("n"), F.max(F.when(inside, value)).alias("hc"), F.max(F.when(inside & (F.col("i") <= tail), value)).alias("hc_tail"))
    return found.withColumn("truncated", most > tail)


def top_per_day(t: DataFrame, k: int, order: list, by: tuple[str, ...] = ("d",)) -> DataFrame:
    """The first k of each day, or of each group ``by``, with their rank; the plan keeps k of each before the shuffle."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return t.withColumn("rank", r).where(F.col("rank") <= k)
