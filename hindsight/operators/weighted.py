"""One alert queue of several arms, ranked by how much likelier a labelled event is at its place in its arm's own tail.

What is learned comes from burn-in queues alone: for each arm the tail of its log p (empirical, continued exponentially
past its ``EXCESS`` smallest), and the exponent a of the labelled events' tail quantiles q, whose density is a q ** (a - 1).
Labelled events that the queue did not reach count as censored at its shallowest quantile. Counts, sums and tails are
aggregates and running counts by arm; the fit sees four numbers of each arm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import prefix

EXCESS = 200
#: Twice the gain in log likelihood from which a weight counts as one (fixed value: 10 % of chi-square with one degree).
DEVIANCE = 2.706


def log_likelihood(a, n, s, m, most):
    """Of n observed log quantiles of sum s, and m censored at ``most``."""
    with np.errstate(divide="ignore"):
        rest = np.where(m > 0, m * np.log(-np.expm1(np.minimum(a * most, -1e-300))), 0.0)
    return n * np.log(a) + (a - 1) * s + rest


@F.pandas_udf(T.StructType([T.StructField("a", T.DoubleType()), T.StructField("deviance", T.DoubleType())]))
def fitted(n: pd.Series, s: pd.Series, m: pd.Series, most: pd.Series) -> pd.DataFrame:
    """The exponent in (0, 1] that fits best, by 200 cuts of a third, and its deviance from 1; 1 where that is not significant."""
    n, s, m, most = (x.fillna(0).to_numpy(float) for x in (n, s, m, most))
    lo, hi = np.full(len(n), 1e-6), np.ones(len(n))
    for _ in range(200):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = log_likelihood(x, n, s, m, most) < log_likelihood(y, n, s, m, most)
        lo, hi = np.where(better, x, lo), np.where(better, hi, y)
    a = (lo + hi) / 2
    gain = np.where(n > 0, 2 * (log_likelihood(a, n, s, m, most) - log_likelihood(np.ones(len(n)), n, s, m, most)), 0.0)
    return pd.DataFrame({"a": np.where(gain > DEVIANCE, a, 1.0), "deviance": gain})


def tails(past: DataFrame, totals: DataFrame, excess: int = EXCESS) -> DataFrame:
    """arm, total, retained, threshold, scale and reached (retained values up to the threshold) from burn-in queues (arm, lp) and evaluations (arm, total)."""
    w = Window.partitionBy("arm").orderBy("lp")
    deep = past.select("arm", "lp", F.row_number().over(w).alias("i")).where(F.col("i") <= excess)  # kept of each arm before the shuffle
    edge = deep.groupBy("arm").agg(F.max("lp").alias("threshold"))
    scale = deep.join(edge, "arm").groupBy("arm", "threshold").agg(F.coalesce(F.avg(F.when(F.col("lp") < F.col("threshold"), F.col("threshold") - F.col("lp"))), F.lit(0.0)).alias("scale"))
    counts = past.join(edge, "arm").groupBy("arm").agg(F.count("*").alias("retained"), F.count_if(F.col("lp") <= F.col("threshold")).alias("reached"))
    return scale.join(counts, "arm").join(totals, "arm").where("retained > 1")


def quantiles(rows: DataFrame, past: DataFrame, tail: DataFrame) -> DataFrame:
    """``rows`` (arm, lp, ...) with lq, the log quantile under the arm's tail; rows of arms without a tail are left out.

    How many retained values lie at or below a row's comes from running counts over both, in ranges of lp.
    """
    extra = [c for c in rows.columns if c not in ("arm", "lp")]
    both = rows.withColumn("_mine", F.lit(0)).unionByName(past.select("arm", "lp", F.lit(-1).alias("_mine")), allowMissingColumns=True)
    counted = prefix(both, ["arm"], ["lp", "_mine"], {"_c": (F.col("_mine") < 0).cast("long")}).where("_mine = 0")
    x = counted.join(F.broadcast(tail), "arm")  # a row for each arm
    beyond = (F.col("lp") < F.col("threshold")) & (F.col("scale") > 0)
    deep = F.log(F.col("reached") / F.col("total")) - (F.col("threshold") - F.col("lp")) / F.col("scale")
    lq = F.when(beyond, deep).when(F.col("_c") == 0, -F.log(F.col("total").cast("double"))).otherwise(F.log(F.col("_c") / F.col("total")))
    return x.select("arm", "lp", *extra, lq.alias("lq"))


def weights(queues: DataFrame, evaluated: DataFrame, tail: DataFrame) -> DataFrame:
    """arm, observed, censored, a and deviance from the burn-in's ``queues`` (arm, off, lq, red) and evaluated labelled events (arm, off)."""
    seen = queues.groupBy("arm").agg(F.max("lq").alias("most"), F.count_if("red").alias("observed"), F.sum(F.when(F.col("red"), F.col("lq"))).alias("s"))
    missed = evaluated.join(queues.select("arm", "off"), ["arm", "off"], "left_anti").groupBy("arm").agg(F.count("*").alias("censored"))
    x = tail.select("arm", "threshold", "scale").join(seen, "arm").join(missed, "arm", "left").withColumn("censored", F.coalesce("censored", F.lit(0)))
    x = x.withColumn("f", fitted("observed", "s", "censored", "most"))
    return x.select("arm", "observed", "censored", "threshold", "scale", F.col("f.a").alias("a"), F.col("f.deviance").alias("deviance"))


def ratio(a: Column, lq: Column) -> Column:
    """The log likelihood ratio of a labelled event at a log quantile."""
    return F.when(a >= 1, 0.0).otherwise(F.log(a) + (a - 1) * F.least(lq, F.lit(0.0)))


def queue(rows: DataFrame, fits: DataFrame, budget: int) -> DataFrame:
    """d, rank, off, ent, at, arm and score: the first ``budget`` of each day of ``rows`` (arm, d, off, ent, at, lq), each event by its best arm."""
    x = rows.join(F.broadcast(fits.select("arm", "a")), "arm").withColumn("score", F.round(ratio(F.col("a"), F.col("lq")), 9))
    best = x.groupBy("d", "off", "ent", "at").agg(F.min(F.struct((-F.col("score")).alias("s"), "arm")).alias("b"))
    order = Window.partitionBy("d").orderBy("b.s", "at", "ent", "off")
    found = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    return found.select("d", "rank", "off", "ent", "at", F.col("b.arm").alias("arm"), (-F.col("b.s")).alias("score"))
