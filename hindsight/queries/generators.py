"""Subsets, injected behaviour, features and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import baselines as B
from ..operators import trees as T
from ..plans import conform as C
from .base import DAY, EVENTS, HOUR, r6


@register("subset_manifest", "SELECT user_id % 4 = 0 AS kept, count(DISTINCT user_id) AS entities, count(*) AS rows_, min(event_id) AS first_off, max(event_id) AS last_off FROM events GROUP BY 1")
def subset_manifest(spark, sf_dir):
    e = C.read(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 4 == 0).alias("kept")).agg(F.countDistinct("user_id").alias("entities"), F.count("*").alias("rows_"), F.min("event_id").alias("first_off"), F.max("event_id").alias("last_off"))


@register(
    "inject_bursts",
    f"""WITH {EVENTS}, p AS (SELECT ent, max(tm) AS last FROM e WHERE ent % 10 = 3 GROUP BY ent), i AS (SELECT ent, last // 1000000 * 1000000 + (s + 1) * 1000000 AS tm, 'takeover' AS event_type FROM p, range(0, 8) r(s))
SELECT ent, tm, event_type, true AS injected FROM i UNION ALL SELECT ent, tm, event_type, false FROM e""",
)
def inject_bursts(spark, sf_dir):
    """Eight takeover events, a second apart, after the last event of each chosen victim, merged with all that was there."""
    e = C.events(spark, sf_dir)
    last = e.where("ent % 10 = 3").groupBy("ent").agg(F.max("at").alias("last"))
    new = last.select("ent", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("s"), "last").select("ent", (F.floor(F.col("last") / 1_000_000) * 1_000_000 + F.col("s") * 1_000_000).alias("tm"), F.lit("takeover").alias("event_type"), F.lit(True).alias("injected"))
    return new.unionByName(e.select("ent", F.col("at").alias("tm"), "event_type", F.lit(False).alias("injected")))


@register("open_vocabulary")
def open_vocabulary(spark, sf_dir):
    """A seeded stream over 300 entities whose second field never runs out of new values."""
    r = spark.range(20_000)
    return r.select(F.col("id").alias("off"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).alias("ent"), (F.lit(C.ORIGIN) + F.col("id") * 60_000_000).alias("tm"), F.concat(F.lit("v"), F.floor(F.sqrt(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000_000)) * (F.col("id") + 1) / 1000))).alias("value"))


FEATURES = ("hour_frac", "dow_frac", "value", "type_h")


def _features(spark, sf_dir):
    e = C.events(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return e.select("off", "ent", "at", (F.pmod("at", F.lit(DAY)) / DAY).alias("hour_frac"), (F.pmod(F.floor(F.col("at") / DAY), F.lit(7)) / 7.0).alias("dow_frac"), "value", F.array_position(kinds, F.col("event_type")).cast("double").alias("type_h"))


@register("features", f"WITH {EVENTS} SELECT off, round((tm % {DAY}) / {DAY}.0, 6) AS hour_frac, round((tm // {DAY}) % 7 / 7.0, 6) AS dow_frac, value, CAST(coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0) AS DOUBLE) AS type_h FROM e")
def features(spark, sf_dir):
    return _features(spark, sf_dir).select("off", r6("hour_frac", "hour_frac"), r6("dow_frac", "dow_frac"), "value", "type_h")


def _baseline(name, f, doc):
    def run(spark, sf_dir):
        return f(_features(spark, sf_dir)).select("off", r6("score", "score"))

    run.__doc__ = doc
    register(name)(run)


_baseline("isolation_forest", lambda x: B.forest(x, "off", list(FEATURES)), "Random single-column cuts.")
_baseline("extended_isolation_forest", lambda x: B.forest(x, "off", list(FEATURES), extended=True), "Random oblique cuts.")
_baseline("local_outlier_factor", lambda x: B.local_outlier_factor(x, "off", list(FEATURES)), "Against 2,000 fitted rows.")
_baseline("principal_error", lambda x: B.principal_error(x, "off", list(FEATURES)), "Reconstruction error of two components.")


@register(
    "entity_ewma",
    f"""WITH {EVENTS}, x AS (SELECT off, ent, tm, value, row_number() OVER (PARTITION BY ent ORDER BY tm, off) AS n FROM e), g AS (SELECT *, pow(2.0, n / 20.0) AS g FROM x),
m AS (SELECT off, value, n, sum(g * value) OVER f / sum(g) OVER f AS mean, sum(g * value * value) OVER f / sum(g) OVER f AS sq FROM g WINDOW f AS (PARTITION BY ent ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT off, round(CASE WHEN n > 2 AND sq - mean * mean > 1e-12 THEN (value - mean) / sqrt(sq - mean * mean) ELSE 0 END, 5) AS z FROM m""",
)
def entity_ewma(spark, sf_dir):
    return B.entity_ewma(C.events(spark, sf_dir)).select("off", F.round("z", 5).alias("z"))


@register("matched_budget", f"WITH {EVENTS}, r AS (SELECT d, event_type, row_number() OVER (PARTITION BY d ORDER BY value DESC, off) AS rank, event_type = 'error' AND value > 60 AS red FROM e) SELECT d, count(*) AS alerts, count(CASE WHEN red THEN 1 END) AS hits FROM r WHERE rank <= 20 GROUP BY d")
def matched_budget(spark, sf_dir):
    """A baseline that ranks by value, at twenty alerts a day."""
    from ..operators.combine import top_per_day
    from .base import red

    e = C.events(spark, sf_dir).select("off", C.day().alias("d"), "value", red().alias("red"))
    return top_per_day(e, 20, [F.desc("value"), "off"]).groupBy("d").agg(F.count("*").alias("alerts"), F.count(F.when(F.col("red"), 1)).alias("hits"))


@register("bounded_novelty")
def bounded_novelty(spark, sf_dir):
    """Novelty of k over at most eight held values of each entity: evictions depend on the order."""
    from ..operators.sketches import bounded_novelty as run

    return run(C.events(spark, sf_dir)).select("off", r6("n_v", "n_v"), "held", r6("overstated", "overstated"), r6("p", "p"))


@register("marginal_numeric")
def marginal_numeric(spark, sf_dir):
    """The value against a 128-centroid sketch of all earlier ones of its type."""
    from ..operators.sketches import marginal_numeric as run

    return run(C.events(spark, sf_dir)).select("off", r6("f", "f"), r6("p", "p"))


#: Stated before the stream: what a column may hold; beyond it, rows take the nearest cell.
BOUNDS = [(0.0, 1.0), (0.0, 1.0), (0.0, 400.0), (0.0, 6.0)]

_FEATURE_SQL = f"f AS (SELECT off, tm, (tm % {DAY}) / {DAY}.0 AS hour_frac, (tm // {DAY}) % 7 / 7.0 AS dow_frac, value, CAST(coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0) AS DOUBLE) AS type_h FROM e)"


@register("half_space_trees", f"WITH {EVENTS}, {_FEATURE_SQL}, {T.sql('f', list(FEATURES), BOUNDS)} SELECT * FROM hst_score")
def half_space_trees(spark, sf_dir):
    """Mass of the last 250 events in an event's cells, over 25 trees."""
    return T.half_space_trees(_features(spark, sf_dir), list(FEATURES), BOUNDS)


#: What a column is divided by before distances are taken.
SCALE = [1.0, 1.0, 100.0, 6.0]


@register("robust_cut_forest")
def robust_cut_forest(spark, sf_dir):
    """The mean displacement of each event in ten cut trees of the 64 before it."""
    from ..operators.cutforest import robust_cut_forest as run

    return run(_features(spark, sf_dir), list(FEATURES), SCALE).select("off", r6("score", "score"))


@register("one_class_svm")
def one_class_svm(spark, sf_dir):
    """Distance from the boundary that holds nine tenths of all events, over features of 100 landmarks."""
    from ..operators.oneclass import one_class_svm as run

    return run(_features(spark, sf_dir), "off", list(FEATURES), SCALE).select("off", r6("score", "score"))
