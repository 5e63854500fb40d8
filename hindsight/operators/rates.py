"""Arms on how often and when: time of day, volume, drift, bursts, co-occurrence, cells of the week."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import phase_of_day, sidak_log, weekly_hour
from ..functions.special import bessel_ratios, least_span
from ..plans.conform import DAY, HALF_LIFE, HOUR, before, by_entity, weight


def harmonics(bandwidth_hours: float = 1.5) -> tuple[float, list[float]]:
    """The concentration of a von Mises kernel of this bandwidth, and its coefficients up to 3 sqrt(2 kappa)."""
    kappa = 1 / (2 * math.pi * bandwidth_hours / 24) ** 2
    return kappa, bessel_ratios(kappa, math.ceil(3 * math.sqrt(2 * kappa)))


def circular_moments(e: DataFrame, n: int, half_life: int = HALF_LIFE) -> DataFrame:
    """``e`` with w0 and, for h = 1..n, c{h} and s{h}: decayed sums of cos and sin of h times the phase, over the entity's earlier events."""
    e = by_entity(e)
    own, frame, phase = weight(F.col("at"), half_life), before("ent"), phase_of_day(F.col("at"))
    total = lambda x: F.coalesce(F.sum(x * own).over(frame), F.lit(0.0)) / own
    return e.select("*", phase.alias("phase"), total(F.lit(1.0)).alias("w0"), F.count("*").over(frame).alias("earlier"), *(total(F.cos(h * phase)).alias(f"c{h}") for h in range(1, n + 1)), *(total(F.sin(h * phase)).alias(f"s{h}") for h in range(1, n + 1)))


def density_at(n: int, coefficients: list[float]):
    """The circular density at the event's own phase, from its moments."""
    s = sum((coefficients[h - 1] * (F.col(f"c{h}") * F.cos(h * F.col("phase")) + F.col(f"s{h}") * F.sin(h * F.col("phase"))) for h in range(1, n + 1)), F.lit(0.0))
    return F.when(F.col("w0") > 0, F.greatest(F.lit(0.0), (1 + 2 * s / F.col("w0")) / (2 * math.pi))).otherwise(1 / (2 * math.pi))


def tail_mass(n: int, coefficients: list[float], grid: int = 512) -> Column:
    """The share of the density's mass that lies no higher than at the event, at least 1 / (2 grid), from the columns of ``circular_moments``."""
    phases = 2 * math.pi * np.arange(grid) / grid
    cos = np.stack([np.cos(h * phases) for h in range(1, n + 1)])
    sin = np.stack([np.sin(h * phases) for h in range(1, n + 1)])
    k = np.array(coefficients)
    cs, ss = [f"c{h}" for h in range(1, n + 1)], [f"s{h}" for h in range(1, n + 1)]

    @F.pandas_udf("double")
    def share(f: pd.DataFrame) -> pd.Series:
        out = np.empty(len(f))
        for at in range(0, len(f), 512):  # the grid of so many events stays in the processor's cache
            part = f.iloc[at : at + 512]
            c, s, w = part[cs].to_numpy(), part[ss].to_numpy(), part["w0"].to_numpy()
            safe = np.where(w > 0, w, 1.0)[:, None]
            dens = np.maximum(0.0, (1 + 2 * ((k * c / safe) @ cos + (k * s / safe) @ sin)) / (2 * math.pi))
            ph = part["phase"].to_numpy()[:, None] * np.arange(1, n + 1)
            own = np.maximum(0.0, (1 + 2 * (k * (c / safe * np.cos(ph) + s / safe * np.sin(ph))).sum(axis=1)) / (2 * math.pi))
            u = np.maximum((dens * (dens <= own[:, None])).sum(axis=1) / dens.sum(axis=1), 1 / (2 * grid))
            out[at : at + 512] = np.where(w > 0, u, 1.0)
        return pd.Series(out)

    return share(F.struct("w0", "phase", *cs, *ss))


def timing(e: DataFrame, least: int = 20, half_life: int = HALF_LIFE, also: tuple[str, ...] = ()) -> DataFrame:
    """off, u, z and status: the log tail mass against the decayed mean and variance of the entity's own earlier ones; and the columns ``also`` of ``e``."""
    _, coefficients = harmonics()
    n = len(coefficients)
    also = tuple(x for x in also if x not in ("off", "ent", "at"))
    # a column of a function in Python keeps the rows where they are, for the second frame
    u = circular_moments(e.select("off", "ent", "at", *also), n, half_life).select("off", "ent", "at", "earlier", *also, tail_mass(n, coefficients).alias("u"))
    frame, own, x = before("ent"), weight(F.col("at"), half_life), F.log("u")
    w, wx, wxx = (F.sum(v * own).over(frame) for v in (F.lit(1.0), x, x * x))
    m = wx / w
    var = F.greatest(F.lit(0.0), wxx / w - m * m)
    ok = (F.col("earlier") >= least) & (var > 1e-12)
    return u.select("off", "ent", "at", *also, "u", F.when(ok, (x - m) / F.sqrt(var)).alias("z"), F.when(ok, "evaluated").otherwise("abstained_structural").alias("status"))


def daily(e: DataFrame) -> DataFrame:
    """ent, d and n, with a row of 0 for each day without events between an entity's first and last."""
    counts = e.groupBy("ent", F.floor(F.col("at") / DAY).alias("d")).agg(F.count("*").alias("n"))
    span = counts.groupBy("ent").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("ent", F.explode(F.sequence("a", "b")).alias("d"))
    return span.join(counts, ["ent", "d"], "left").select("ent", "d", F.coalesce("n", F.lit(0)).alias("n"))


def gamma_posterior(e: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """ent, d, n, a and b: events and days before d, discounted by day, as a gamma posterior with prior (1, 1)."""
    w = F.pow(F.lit(2.0), (F.col("d") - F.lit(19723)) / F.lit(half_life_days))
    past = Window.partitionBy("ent").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    scale = F.pow(F.lit(2.0), (F.col("d") - 1 - F.lit(19723)) / F.lit(half_life_days))
    return daily(e).select("ent", "d", "n", (1 + F.coalesce(F.sum(F.col("n") * w).over(past) / scale, F.lit(0.0))).alias("a"), (1 + F.coalesce(F.sum(w).over(past) / scale, F.lit(0.0))).alias("b"))


def hour_shares(e: DataFrame, half_life: int = HALF_LIFE) -> DataFrame:
    """ent, hour, k (events in it) and share: the part of the entity's day that its density of earlier hours puts into this hour.

    The density is the von Mises kernel's with all its harmonics, integrated over the hour in closed form from decayed moments; the
    truncated series may leave [0, 1], to which the share is cut. Without earlier hours it is 1/24. Moments are summed by hour first, so
    that only hours are scanned.
    """
    _, coefficients = harmonics()
    own, phase = weight(F.col("at"), half_life), phase_of_day(F.col("at"))
    waves = [(f"{c}{h}", f, h) for h in range(1, len(coefficients) + 1) for c, f in (("c", F.cos), ("s", F.sin))]
    sums = e.select("ent", "at").repartition("ent").groupBy("ent", F.floor(F.col("at") / HOUR).alias("hour")).agg(F.count("*").alias("k"), F.sum(own).alias("w"), *(F.sum(own * f(h * phase)).alias(n) for n, f, h in waves))
    frame = Window.partitionBy("ent").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select("ent", "hour", "k", *(F.sum(n).over(frame).alias(n) for n in ("w", *(n for n, _, _ in waves))))
    share = F.lit(1 / 24)
    for h, r in enumerate(coefficients, 1):
        a, b = (h * 2 * math.pi / 24 * (F.pmod(F.col("hour"), F.lit(24)) + x) for x in (0, 1))
        share = share + (F.col(f"c{h}") * (F.sin(b) - F.sin(a)) - F.col(f"s{h}") * (F.cos(b) - F.cos(a))) / F.col("w") * (r / (h * math.pi))
    return past.select("ent", "hour", "k", F.when(share.isNull(), 1 / 24).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).alias("share"))


def volume(e: DataFrame, least_hours: int = 5, half_life: int = HALF_LIFE) -> DataFrame:
    """ent, hour, k, share, expected, dispersion and status of each hour with events.

    The expected count is the day's rate times the hour's share of the entity's day (``hour_shares``). The dispersion is the
    decayed mean of (k - e)^2 / e over the entity's earlier hours of which anything was expected, at least 1, and
    null before ``least_hours`` of them: the arm abstains there, as the width of its null is not known.
    """
    hours = hour_shares(e, half_life).withColumn("d", F.floor(F.col("hour") / 24))
    # ``gamma_posterior`` from the hours: days without events add nothing to a, and b is a geometric series over all days since the first
    days = Window.partitionBy("ent").orderBy("d")
    fade = 2.0 ** (-1 / 7.0)
    a = 1 + F.coalesce(F.sum(F.col("k") * F.pow(F.lit(2.0), (F.col("d") - 19723) / F.lit(7.0))).over(days.rangeBetween(Window.unboundedPreceding, -1)) / F.pow(F.lit(2.0), (F.col("d") - 1 - 19723) / F.lit(7.0)), F.lit(0.0))
    b = 1 + (1 - F.pow(F.lit(fade), F.col("d") - F.min("d").over(days.rowsBetween(Window.unboundedPreceding, 0)))) / (1 - fade)
    x = hours.withColumn("rate", a / b).withColumn("expected", F.col("rate") * F.col("share"))
    frame = Window.partitionBy("ent").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    w = F.when(F.col("expected") > 0, F.pow(F.lit(2.0), (F.col("hour") * F.lit(float(HOUR)) - F.lit(1_704_067_200_000_000)) / F.lit(float(half_life))))
    res = F.pow(F.col("k") - F.col("expected"), F.lit(2)) / F.nullif(F.col("expected"), F.lit(0.0))
    ok = F.count(w).over(frame) >= least_hours
    phi = F.when(ok, F.greatest(F.lit(1.0), F.sum(res * w).over(frame) / F.sum(w).over(frame)))
    said = ok | (F.col("expected") <= 0)
    return x.select("ent", "hour", "k", "share", "expected", phi.alias("dispersion"), F.when(said, "evaluated").otherwise("abstained_unusable").alias("status"))


def drift(e: DataFrame, shift: float = 1.3, least: int = 8) -> DataFrame:
    """ent, d, n, cusum, z and status by day.

    The reference is rate (s - 1) / ln s; max(0, S + n - ref) is the running sum less its running
    minimum; z compares it with the entity's own earlier values. The day on which a rate first exists folds nothing.
    """
    post = gamma_posterior(e)
    ref = F.col("a") / F.col("b") * ((shift - 1) / math.log(shift))
    w = Window.partitionBy("ent").orderBy("d")
    first = F.row_number().over(w) == 1
    x = post.withColumn("step", F.when(first, 0.0).otherwise(F.col("n") - ref)).withColumn("total", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("cusum", F.col("total") - F.least(F.lit(0.0), F.min("total").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    m, sd = F.avg("cusum").over(past), F.stddev_samp("cusum").over(past)
    ok = (F.count("*").over(past) >= least) & (sd > 0)
    return x.select("ent", "d", "n", "cusum", F.when(ok, (F.col("cusum") - m) / sd).alias("z"), F.when(ok, "evaluated").otherwise("abstained_structural").alias("status"))


def burst(e: DataFrame, least: int = 50, longest: int = 32, half_life: int = HALF_LIFE) -> DataFrame:
    """ent, at, gaps, kappa, theta and spans (seconds, of the newest 3..32 instants, this one included) of each distinct instant."""
    return burst_of(e.select("ent", "at").repartition("ent").distinct(), least, longest, half_life)


def burst_of(x: DataFrame, least: int = 50, longest: int = 32, half_life: int = HALF_LIFE, also: tuple[str, ...] = ()) -> DataFrame:
    """``burst`` of instants that stand once each, and the columns ``also`` of theirs."""
    w = Window.partitionBy("ent").orderBy("at")
    x = x.withColumn("gap", (F.col("at") - F.lag("at").over(w)) / 1e6)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = weight(F.col("at"), half_life)
    wn, wg, wgg = (F.sum(F.when(F.col("gap") > 0, v * own)).over(upto) for v in (F.lit(1.0), F.col("gap"), F.col("gap") * F.col("gap")))
    x = x.withColumn("gaps", F.count("gap").over(upto)).withColumn("m", wg / wn).withColumn("var", wgg / wn - F.pow(wg / wn, F.lit(2)))
    kappa = F.when(F.col("var") > 0, F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("m") * F.col("m") / F.col("var")))).otherwise(1.0)
    last = F.collect_list("at").over(w.rowsBetween(-(longest - 1), 0))
    spans = F.when(F.size(last) >= 3, F.transform(F.sequence(F.lit(3), F.greatest(F.size(last), F.lit(3))), lambda k: F.greatest(F.lit(1.0), (F.col("at") - F.element_at(last, -k)) / 1e6)))
    return x.withColumn("kappa", kappa).select("ent", "at", *also, "gaps", "kappa", (F.col("m") / F.col("kappa")).alias("theta"), spans.alias("spans"), F.when(F.col("gaps") >= least, "evaluated").otherwise("abstained_structural").alias("status"))


def burst_log_p(scored: DataFrame) -> DataFrame:
    """ent, at, tests and log_p of the evaluated rows of ``burst``: the least log probability that a gamma of (k - 1) kappa gaps is as short, corrected for the number of spans."""
    x = scored.where("status = 'evaluated' and spans is not null")
    return x.select("ent", "at", F.size("spans").alias("tests"), least_span(F.col("kappa"), F.col("theta"), F.col("spans")).alias("lp")).withColumn("log_p", sidak_log(F.col("lp"), F.col("tests")))


def cooccurrence(e: DataFrame, a: str = "event_type", b: str = "k", half_life: int = HALF_LIFE) -> DataFrame:
    """off, w, k_a, k_b, total and lam: decayed weight of the event's edge, of both nodes and of the graph before it, and the expected weight k_a k_b / 2 m.

    Two-level prefix sums; the total is scanned by hour so that it is not one task's work.
    """
    from ..plans.conform import running

    rows = e.where(F.col("known") & F.col(a).isNotNull() & F.col(b).isNotNull()).select("off", "at", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(0).alias("all"))
    own = weight(F.col("at"), half_life)
    x = running(rows, ["a", "b"], {"we": own})
    x = running(x, ["a"], {"wa": own})
    x = running(x, ["b"], {"wb": own})
    x = running(x, ["all"], {"wt": own}, F.floor(F.col("at") / HOUR).cast("long"))
    # each event adds 1 to its edge, to both ends and to the total
    return x.select("off", (F.col("we") / own).alias("w"), (F.col("wa") / own).alias("k_a"), (F.col("wb") / own).alias("k_b"), (F.col("wt") / own).alias("total"), F.when(F.col("wt") > 0, F.col("wa") * F.col("wb") / (2 * F.col("wt")) / own).otherwise(0.0).alias("lam"))


def cell_grid(e: DataFrame) -> DataFrame:
    """Novelty of the hour of the week."""
    from .novelty import dirichlet

    return dirichlet(e.withColumn("cell", weekly_hour(F.col("at"))), "cell")


def block_lambda(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """a, b, w, lam and fallback: the expected weight of each edge (a, b, w) given the nodes' blocks (node, block).

    The configuration model's k_a k_b / 2m, times the weight between both blocks over what that model
    expects between them; where a node has no block, the configuration model alone (``fallback``).
    Node names of the two ends do not meet. An edge or node stands once.
    """
    ends = edges.select(F.col("a").alias("node"), "w").unionAll(edges.select("b", "w"))
    nodes = ends.groupBy("node").agg(F.sum("w").alias("k")).join(blocks, "node", "left")
    total = edges.agg((2 * F.sum("w")).alias("total"))
    x = edges.join(nodes.toDF("a", "k_a", "r"), "a").join(nodes.toDF("b", "k_b", "s"), "b")
    sums = nodes.where("block is not null").groupBy("block").agg(F.sum("k").alias("d"))
    between = x.where("r is not null and s is not null").groupBy("r", "s").agg(F.sum("w").alias("m"))
    x = x.join(between, ["r", "s"], "left").join(sums.toDF("r", "d_r"), "r", "left").join(sums.toDF("s", "d_s"), "s", "left").crossJoin(F.broadcast(total))  # a single row
    fallback = F.col("r").isNull() | F.col("s").isNull()
    affinity = F.when(fallback, 1.0).otherwise(F.col("m") * F.col("total") / (F.col("d_r") * F.col("d_s")))
    return x.select("a", "b", "w", (F.col("k_a") * F.col("k_b") / F.col("total") * affinity).alias("lam"), fallback.alias("fallback"))
