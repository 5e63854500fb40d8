"""Reports over entities, arms and alerts: memory, shape of the day, categories, depth, ablation, operating points."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..plans import conform as C
from .base import DAY, EVENTS, HL, HOUR, LABELS, VERDICTS, r6, verdicts
from .ranking import _ARM, _arms, _labels

HARMONICS = 3


@register(
    "effective_sample_size",
    f"""WITH {EVENTS}, g AS (SELECT ent, count(*) AS n, (max(tm) - min(tm)) / nullif(count(*) - 1, 0) AS gap, max(tm) AS last FROM e GROUP BY ent)
SELECT ent, n, round(gap / {HOUR}.0, 6) AS gap_hours, round(1 / (1 - pow(2.0, -gap / {float(HL)})), 6) AS saturates_at FROM g WHERE gap > 0""",
)
def effective_sample_size(spark, sf_dir):
    """Weight at which an entity's decayed history saturates, 1 / (1 - factor of its mean gap); entities of one time have none."""
    g = C.events(spark, sf_dir).groupBy("ent").agg(F.count("*").alias("n"), ((F.max("at") - F.min("at")) / F.nullif(F.count("*") - 1, F.lit(0))).alias("gap")).where("gap > 0")
    return g.select("ent", "n", r6(F.col("gap") / float(HOUR), "gap_hours"), r6(1 / (1 - F.pow(F.lit(2.0), -F.col("gap") / float(HL))), "saturates_at"))


def _moments_sql(h: int) -> str:
    return f"sum(wt * cos({h} * 2 * pi() * (tm % {DAY}) / {DAY}.0)) / sum(wt) AS c{h}, sum(wt * sin({h} * 2 * pi() * (tm % {DAY}) / {DAY}.0)) / sum(wt) AS s{h}"


def _term_sql(h: int) -> str:
    a, b = f"{h} * 2 * pi() * h / 24", f"{h} * 2 * pi() * (h + 1) / 24"
    return f"(c{h} * (sin({b}) - sin({a})) - s{h} * (cos({b}) - cos({a}))) / ({h} * pi())"


@register(
    "window_fraction",
    f"""WITH {EVENTS}, m AS (SELECT ent, {', '.join(_moments_sql(h) for h in range(1, HARMONICS + 1))} FROM e GROUP BY ent)
SELECT ent, h AS hour, round(1 / 24.0 + {' + '.join(_term_sql(h) for h in range(1, HARMONICS + 1))}, 6) AS fraction FROM m, (SELECT unnest(range(0, 24)) AS h) t""",
)
def window_fraction(spark, sf_dir):
    """Share of an entity's day in each hour: the integral of its Fourier density over the hour, in closed form."""
    phase = S.phase_of_day(F.col("at"))
    w = C.weight(F.col("at"))
    m = C.events(spark, sf_dir).groupBy("ent").agg(
        *((F.sum(w * F.cos(j * phase)) / F.sum(w)).alias(f"c{j}") for j in range(1, HARMONICS + 1)), *((F.sum(w * F.sin(j * phase)) / F.sum(w)).alias(f"s{j}") for j in range(1, HARMONICS + 1))
    )
    m = m.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    share = F.lit(1 / 24)
    for j in range(1, HARMONICS + 1):
        a, b = (j * 2 * math.pi / 24 * (F.col("hour") + k) for k in (0, 1))
        share = share + (F.col(f"c{j}") * (F.sin(b) - F.sin(a)) - F.col(f"s{j}") * (F.cos(b) - F.cos(a))) / (j * math.pi)
    return m.select("ent", "hour", r6(share, "fraction"))


@register(
    "hour_modes",
    f"""WITH {EVENTS}, c AS (SELECT ent, CAST(tm // {HOUR} % 24 AS BIGINT) AS hour, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT ent, sum(n) AS total FROM c GROUP BY ent)
SELECT c.ent, c.hour, c.n FROM c JOIN t USING (ent) LEFT JOIN c a ON a.ent = c.ent AND a.hour = (c.hour + 23) % 24 LEFT JOIN c b ON b.ent = c.ent AND b.hour = (c.hour + 1) % 24
WHERE c.n > coalesce(a.n, 0) AND c.n >= coalesce(b.n, 0) AND c.n * 24 > total""",
)
def hour_modes(spark, sf_dir):
    """Hours of the day that are local maxima of an entity's activity, above the uniform share; the day is a circle."""
    c = C.events(spark, sf_dir).groupBy("ent", F.pmod(F.floor(F.col("at") / HOUR), F.lit(24)).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    day = c.groupBy("ent").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("by"))  # at most 24 hours each
    at = lambda h: F.coalesce(F.try_element_at("by", F.pmod(h, F.lit(24)).cast("long")), F.lit(0).cast("long"))
    x = day.select("ent", "total", "by", F.explode(F.map_keys("by")).alias("hour"))
    n = at(F.col("hour"))
    return x.where((n > at(F.col("hour") - 1)) & (n >= at(F.col("hour") + 1)) & (n * 24 > F.col("total"))).select("ent", "hour", n.alias("n"))


_CATEGORIES = f"""firsts AS (SELECT off, ent, tm, d, k, row_number() OVER (PARTITION BY ent, k ORDER BY tm, off) = 1 AS novel_value, row_number() OVER (PARTITION BY ent, event_type, k ORDER BY tm, off) = 1 AS novel_pair FROM e),
kd AS (SELECT k, d, count(*) AS n FROM e GROUP BY ALL), days AS (SELECT d, coalesce(sum(count(*)) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM e GROUP BY d),
kp AS (SELECT k, d, coalesce(sum(n) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM kd),
hh AS (SELECT ent, tm // {HOUR} AS hour, count(*) AS burst FROM e GROUP BY ALL),
cat AS (SELECT f.off, f.d, novel_value, novel_pair AND NOT novel_value AS novel_pair, total > 0 AND prior < 0.005 * total AS population_rare, burst >= 3 AS volume_burst
 FROM firsts f JOIN days USING (d) LEFT JOIN kp ON kp.k = f.k AND kp.d = f.d JOIN hh ON hh.ent = f.ent AND hh.hour = f.tm // {HOUR} WHERE f.k IS NOT NULL)"""


def _categories(spark, sf_dir):
    """novel_value, novel_pair, population_rare (below 0.5 % of the days before) and volume_burst (three in an hour) of each event with k."""
    e = C.events(spark, sf_dir).withColumn("d", C.day()).withColumn("hour", F.floor(F.col("at") / HOUR))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("at", "off")) == 1
    x = e.where("k is not null").withColumn("novel_value", first("ent", "k")).withColumn("novel_pair", first("ent", "event_type", "k") & ~F.col("novel_value"))
    past = lambda *keys: Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy("d").agg(F.count("*").alias("n")).select("d", F.coalesce(F.sum("n").over(past()), F.lit(0)).alias("total"))  # a row for each day
    prior = e.groupBy("k", "d").agg(F.count("*").alias("n")).select("k", "d", F.coalesce(F.sum("n").over(past("k")), F.lit(0)).alias("prior"))
    hours = e.groupBy("ent", "hour").agg(F.count("*").alias("burst"))
    x = x.join(days, "d").join(prior, ["k", "d"]).join(hours, ["ent", "hour"])
    return x.select("off", "d", "novel_value", "novel_pair", ((F.col("total") > 0) & (F.col("prior") < 0.005 * F.col("total"))).alias("population_rare"), (F.col("burst") >= 3).alias("volume_burst"))


_NAMES = ("novel_value", "novel_pair", "population_rare", "volume_burst")


@register("anomaly_categories", f"WITH {EVENTS}, {_CATEGORIES} SELECT off, {', '.join(_NAMES)} FROM cat")
def anomaly_categories(spark, sf_dir):
    """Categories of each event as booleans."""
    return _categories(spark, sf_dir).select("off", *_NAMES)


@register("category_census", f"WITH {EVENTS}, {_CATEGORIES} SELECT d, count(*) AS events, {', '.join(f'count(CASE WHEN {n} THEN 1 END) AS {n}' for n in _NAMES)} FROM cat GROUP BY d")
def category_census(spark, sf_dir):
    """Events of each category by day."""
    return _categories(spark, sf_dir).groupBy("d").agg(F.count("*").alias("events"), *(F.count_if(n).alias(n) for n in _NAMES))


_Z = "1.959963984540054"


@register(
    "arm_intervals",
    f"""WITH {VERDICTS}, {_ARM}, {LABELS}, x AS (SELECT detector, count(*) AS n, CAST(sum(red) AS BIGINT) AS hits FROM ranked JOIN lab USING (off) WHERE rank <= 25 GROUP BY 1), y AS (SELECT *, hits / n AS p FROM x)
SELECT detector, n, hits, round(greatest(0, (p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) - {_Z} / (1 + {_Z}*{_Z}/n) * sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))), 6) AS low, round(least(1, (p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) + {_Z} / (1 + {_Z}*{_Z}/n) * sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))), 6) AS high FROM y""",
)
def arm_intervals(spark, sf_dir):
    """Precision of each arm's daily 25 with its Wilson interval."""
    x = _arms(spark, sf_dir, 25).join(_labels(spark, sf_dir), "off").groupBy("detector").agg(F.count("*").alias("n"), F.sum("red").alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return x.select("detector", "n", "hits", r6(low, "low"), r6(high, "high"))


@register(
    "arm_ablation",
    f"""WITH {VERDICTS}, {_ARM}, {LABELS}, u AS (SELECT off, count(DISTINCT detector) AS carriers, any_value(detector) AS only_one FROM ranked WHERE rank <= 20 GROUP BY off)
SELECT only_one AS detector, count(*) AS alerts_lost, CAST(sum(red) AS BIGINT) AS hits_lost FROM u JOIN lab USING (off) WHERE carriers = 1 GROUP BY 1""",
)
def arm_ablation(spark, sf_dir):
    """What the union of the arms' daily twenties loses without each arm: alerts, and labelled events, that it alone carries."""
    u = _arms(spark, sf_dir, 20).groupBy("off").agg(F.count("*").alias("carriers"), F.first("detector").alias("detector")).where("carriers = 1")
    return u.join(_labels(spark, sf_dir), "off").groupBy("detector").agg(F.count("*").alias("alerts_lost"), F.sum("red").alias("hits_lost"))


@register(
    "operating_points",
    f"""WITH {VERDICTS}, {_ARM}, c AS (SELECT detector, d, max(CASE WHEN rank <= 10 THEN p END) AS cut, count(*) AS n FROM ranked GROUP BY 1, 2)
SELECT detector, d, round(cut, 6) AS cut, n, round(ln((n - 10) / 10.0), 6) AS log_prior_odds FROM c WHERE n > 10""",
)
def operating_points(spark, sf_dir):
    """For a budget of ten a day, each arm's p at the cut and the log odds that an event is let go, on days with more events than that."""
    v = verdicts(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("d", C.day())
    cut = _arms(spark, sf_dir, 10).groupBy("detector", "d").agg(F.max("p").alias("cut"))
    n = v.groupBy("detector", "d").agg(F.count("*").alias("n")).where("n > 10")
    return n.join(cut, ["detector", "d"]).select("detector", "d", r6("cut", "cut"), "n", r6(F.log((F.col("n") - 10) / 10.0), "log_prior_odds"))


@register(
    "head_to_head",
    f"""WITH {VERDICTS}, {_ARM}, {LABELS}, h AS (SELECT detector, d, count(*) AS n, CAST(sum(red) AS BIGINT) AS hits FROM ranked JOIN lab USING (off) WHERE rank <= 20 GROUP BY 1, 2 HAVING count(*) = 20)
SELECT a.detector AS first, b.detector AS second, count(*) AS days, CAST(sum(a.hits) AS BIGINT) AS first_hits, CAST(sum(b.hits) AS BIGINT) AS second_hits, count(CASE WHEN a.hits > b.hits THEN 1 END) AS first_wins, count(CASE WHEN a.hits < b.hits THEN 1 END) AS second_wins
FROM h a JOIN h b USING (d) WHERE a.detector < b.detector GROUP BY 1, 2""",
)
def head_to_head(spark, sf_dir):
    """Arms by pairs, on the days on which both fill a budget of twenty: labelled events found and days won."""
    h = _arms(spark, sf_dir, 20).join(_labels(spark, sf_dir), "off").groupBy("detector", "d").agg(F.count("*").alias("n"), F.sum("red").alias("hits")).where("n = 20")
    a, b = (h.select("d", F.col("detector").alias(s), F.col("hits").alias(f"{s}_h")) for s in ("first", "second"))
    x = a.join(b, "d").where("first < second")  # arms by day: a handful of rows each
    return x.groupBy("first", "second").agg(
        F.count("*").alias("days"), F.sum("first_h").alias("first_hits"), F.sum("second_h").alias("second_hits"), F.count_if(F.col("first_h") > F.col("second_h")).alias("first_wins"), F.count_if(F.col("first_h") < F.col("second_h")).alias("second_wins"),
    )
