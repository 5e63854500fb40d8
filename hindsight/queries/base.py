"""SQL text that several queries share: the event model, the settled gate, novelty tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import conform as C

HL, ORIGIN, DAY, HOUR = C.HALF_LIFE, C.ORIGIN, C.DAY, C.HOUR


def r6(x: Column | str, name: str) -> Column:
    return F.round(x, 6).alias(name)


def settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.settled(C.events(spark, sf_dir))


BAND = """CASE WHEN {x} = 0 THEN '[0]' ELSE (SELECT CASE WHEN {x} > 0 THEN '[' || lo || 'e' || e || ',' || hi || 'e' || he || ')' ELSE '(-' || hi || 'e' || he || ',-' || lo || 'e' || e || ']' END FROM
 (SELECT CASE WHEN m < 2 THEN '1' WHEN m < 5 THEN '2' ELSE '5' END AS lo, CASE WHEN m < 2 THEN '2' WHEN m < 5 THEN '5' ELSE '1' END AS hi, e, CASE WHEN m < 5 THEN e ELSE e + 1 END AS he FROM
 (SELECT CAST(split_part(t, 'e', 1) AS DOUBLE) AS m, CAST(split_part(t, 'e', 2) AS INTEGER) AS e FROM (SELECT printf('%.16e', abs({x})) AS t)))) END"""

EVENTS = f"""e0 AS (SELECT event_id AS off, user_id AS ent, epoch_us(ts) AS tm, event_type, value, json_extract_string(props, '$.k') AS k, {BAND.format(x='value')} AS band FROM events),
gate AS (SELECT tm AS s_at, off AS s_off FROM (SELECT tm, off, row_number() OVER (ORDER BY tm, off) AS rn FROM e0) WHERE rn = 50),
e AS (SELECT e0.*, coalesce((tm, off) > (s_at, s_off), false) AS known, pow(2.0, (tm - {ORIGIN}) / {float(HL)}) AS wt, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d FROM e0 LEFT JOIN gate ON true)"""


def novelty_ctes(name: str, value: str) -> str:
    """CTEs that end in ``{name}_p`` (off, ent, at, n_v, n, k, p)."""
    n = name
    return f"""{n}_r AS (SELECT ent, off, tm, {value} AS v, known, wt FROM e WHERE {value} IS NOT NULL),
{n}_m AS (SELECT r.off, r.ent, r.tm, r.v, u, known,
  coalesce(sum(CASE WHEN known AND v = u THEN wt END) OVER f, 0.0) / wt AS n_u, count(CASE WHEN known AND v = u THEN 1 END) OVER f AS seen
  FROM {n}_r r LEFT JOIN (SELECT DISTINCT ent, v AS u FROM {n}_r WHERE known) USING (ent)
  WINDOW f AS (PARTITION BY r.ent, u ORDER BY r.tm, r.off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{n}_o AS (SELECT off, ent, tm, coalesce(sum(CASE WHEN seen > 0 THEN n_u END), 0.0) AS n, CAST(count(CASE WHEN seen > 0 THEN 1 END) AS BIGINT) AS k,
  coalesce(max(CASE WHEN u = v AND seen > 0 THEN n_u END), 0.0) AS n_v, max(CASE WHEN u = v AND seen > 0 THEN 1 ELSE 0 END) AS was_seen FROM {n}_m WHERE known GROUP BY off, ent, tm),
{n}_p AS (SELECT o.off, o.ent, o.tm, o.n_v, o.n, o.k, CASE WHEN o.k = 0 THEN 1.0 WHEN was_seen = 0 THEN 1.0 / (o.n + o.k + 1) ELSE least(1.0, (coalesce(t.s, 0.0) + 1.0) / (o.n + o.k + 1)) END AS p
  FROM {n}_o o LEFT JOIN (SELECT m.off, sum(n_u + 1.0) AS s FROM {n}_m m JOIN {n}_o q USING (off) WHERE m.known AND m.seen > 0 AND m.n_u <= q.n_v GROUP BY m.off) t USING (off))"""


VERDICTS = f"""{EVENTS},
{novelty_ctes('ty', 'event_type')},
{novelty_ctes('kk', 'k')},
{novelty_ctes('bd', 'band')},
v AS (SELECT off, ent, tm, 'novelty_band' AS detector, p FROM bd_p UNION ALL SELECT off, ent, tm, 'novelty_event_type', p FROM ty_p UNION ALL SELECT off, ent, tm, 'novelty_k', p FROM kk_p)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """off, ent, at, detector, p: novelty of three fields, settled events only."""
    from ..operators import arms

    return arms.table(spark, sf_dir).where(F.col("detector").isin("novelty_band", "novelty_event_type", "novelty_k")).select("off", "ent", "at", "detector", "p")


#: x2, j and Fisher's tail of each event: the finite sum for up to three verdicts.
COMBINED = f"""{VERDICTS},
c AS (SELECT off, any_value(ent) AS ent, any_value(tm) AS tm, count(*) AS j, sum(-2 * ln(p)) AS x2, min(p) AS min_p FROM v GROUP BY off),
f AS (SELECT *, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, least(1.0, exp(-x2 / 2) * (1 + CASE WHEN j > 1 THEN x2 / 2 ELSE 0 END + CASE WHEN j > 2 THEN x2 * x2 / 8 ELSE 0 END)) AS fisher_p, CASE WHEN min_p >= 1 THEN 1.0 ELSE 1 - pow(1 - min_p, j) END AS minp_p FROM c)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """off, ent, at, d, j, x2, fisher_p, min_p, minp_p, and the stated label: an error event with a value over 60."""
    from ..operators.combine import combined

    v = verdicts(spark, sf_dir)
    who = C.events(spark, sf_dir).select("off", "ent", "at", C.day().alias("d"), red().alias("red"))
    return combined(v).join(who, "off")


def red() -> Column:
    return (F.col("event_type") == "error") & (F.col("value") > 60)


LABELS = "lab AS (SELECT off, CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS red FROM e0)"
