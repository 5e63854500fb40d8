"""The graph of values that stand together in events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import pairgraph as G
from ..plans import conform as C
from .base import EVENTS, r6, settled_events

FIELDS = ("band", "event_type", "k")

_BLOCK = """CASE f WHEN 'event_type' THEN 'event_type:' || length(v) % 2 WHEN 'band' THEN 'band:' || CASE WHEN starts_with(v, '[') THEN 'up' ELSE 'down' END
 ELSE CASE WHEN length(v) < 2 THEN NULL ELSE 'k:' || TRY_CAST(v AS INTEGER) % 3 END END"""

_W = "(PARTITION BY {} ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

PAIRS = f"""{EVENTS}, n0 AS (SELECT off, ent, tm, wt, UNNEST([{{'f': 'band', 'v': band}}, {{'f': 'event_type', 'v': event_type}}, {{'f': 'k', 'v': k}}]) AS x FROM e WHERE known),
n1 AS (SELECT off, ent, tm, wt, x.f AS f, x.v AS v, count(*) OVER (PARTITION BY off) AS fe FROM n0 WHERE x.v IS NOT NULL),
ev AS (SELECT DISTINCT off, tm, wt, fe FROM n1 WHERE fe >= 2), tt AS (SELECT off, coalesce(sum(wt * fe * (fe - 1) / 2) OVER (ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS wall FROM ev),
n2 AS (SELECT *, {_BLOCK} AS b, coalesce(sum(wt * (fe - 1)) OVER {_W.format('f, v')}, 0.0) AS deg FROM n1 WHERE fe >= 2),
bd AS (SELECT b, off, coalesce(sum(s) OVER {_W.format('b')}, 0.0) AS d FROM (SELECT b, off, tm, sum(wt * (fe - 1)) AS s FROM n2 WHERE b IS NOT NULL GROUP BY ALL)),
n3 AS (SELECT n2.*, bd.d FROM n2 LEFT JOIN bd USING (b, off)),
p0 AS (SELECT x.off, x.ent, x.tm, x.wt, x.f AS f_a, x.v AS v_a, y.f AS f_b, y.v AS v_b, x.deg AS ka, y.deg AS kb, x.d AS dr, y.d AS ds, least(x.b, y.b) AS lo, greatest(x.b, y.b) AS hi, x.b IS NOT NULL AND y.b IS NOT NULL AS placed FROM n3 x JOIN n3 y ON x.off = y.off AND x.f < y.f),
p1 AS (SELECT *, coalesce(sum(wt) OVER {_W.format('f_a, v_a, f_b, v_b')}, 0.0) AS we FROM p0),
bm AS (SELECT lo, hi, off, coalesce(sum(s) OVER {_W.format('lo, hi')}, 0.0) AS m FROM (SELECT lo, hi, off, tm, sum(wt * CASE WHEN lo = hi THEN 2 ELSE 1 END) AS s FROM p1 WHERE placed GROUP BY lo, hi, off, tm)),
p2 AS (SELECT p1.*, wall, CASE WHEN placed THEN bm.m END AS m, NOT coalesce(placed AND dr > 0 AND ds > 0, false) AS fallback FROM p1 JOIN tt USING (off) LEFT JOIN bm ON bm.off = p1.off AND bm.lo = p1.lo AND bm.hi = p1.hi),
pp AS (SELECT *, CASE WHEN fallback THEN CASE WHEN wall > 0 THEN ka * kb / (2 * wall) / wt ELSE 0 END ELSE ka * kb / wt * m / (dr * ds) END AS lam FROM p2)"""


def _fields():
    return {f: F.col(f) for f in FIELDS}


def stated_blocks(e):
    """A partition by rule: event types by length, bands by sign, values of k by remainder; values of one digit have no block."""
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("n")
    n = e.select(listed).select("n.field", "n.value").where("value is not null").distinct()
    k = F.when(F.length("value") >= 2, F.concat(F.lit("k:"), F.expr("try_cast(value as int) % 3")))
    block = F.when(F.col("field") == "event_type", F.concat(F.lit("event_type:"), F.length("value") % 2)).when(F.col("field") == "band", F.when(F.col("value").startswith("["), "band:up").otherwise("band:down")).otherwise(k)
    return n.withColumn("block", block).where("block is not null")


@register("cooccurrence_pairs", f"WITH {PAIRS} SELECT off, f_a, v_a, f_b, v_b, round(we / wt, 6) AS w, round(ka / wt, 6) AS k_a, round(kb / wt, 6) AS k_b, round(wall / wt, 6) AS total, round(dr / wt, 6) AS d_r, round(ds / wt, 6) AS d_s, round(m / wt, 6) AS m_rs, round(lam, 6) AS lam, fallback FROM pp")
def cooccurrence_pairs(spark, sf_dir):
    """All pairs of each event's values with their expected weight under a stated partition, blocks at each prefix."""
    e = settled_events(spark, sf_dir)
    x = G.priced_pairs(e, _fields(), stated_blocks(C.events(spark, sf_dir)))
    return x.select("off", "f_a", "v_a", "f_b", "v_b", *(r6(c, c) for c in ("w", "k_a", "k_b", "total", "d_r", "d_s", "m_rs", "lam")), "fallback")


@register(
    "cooccurrence_least",
    f"""WITH {PAIRS}, q AS (SELECT *, CASE WHEN lam > 0 THEN least(0.0, ln(list_sum(list_transform(range(0, CAST(floor(we / wt + 1e-9) AS BIGINT) + 1), lambda i: exp(CASE WHEN i > 0 THEN i * ln(lam) - lgamma(i + 1.0) ELSE 0 END - lam))))) ELSE 0.0 END AS lp FROM pp),
r AS (SELECT *, row_number() OVER (PARTITION BY off ORDER BY round(lp, 9), f_a, f_b) AS rn, count(*) OVER (PARTITION BY off) AS tests FROM q)
SELECT off, ent, tests, f_a, f_b, fallback, round(lp, 5) + 0.0 AS least, round(CASE WHEN lp >= 0 THEN 0.0 WHEN lp < -30 THEN ln(tests) + lp ELSE ln(1 - pow(1 - exp(lp), tests)) END, 5) + 0.0 AS log_p FROM r WHERE rn = 1""",
)
def cooccurrence_least(spark, sf_dir):
    """One verdict for each event: the pair whose weight is least likely to be so low, corrected for the number of pairs."""
    e = settled_events(spark, sf_dir)
    x = G.least_pair(G.priced_pairs(e, _fields(), stated_blocks(C.events(spark, sf_dir))))
    return x.select("off", "ent", "tests", "f_a", "f_b", "fallback", (F.round("least", 5) + 0.0).alias("least"), (F.round("log_p", 5) + 0.0).alias("log_p"))
