"""What happens to alerts when a field joins the schema: both treatments, before and after, at several levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import growth as W
from ..plans import conform as C
from .base import DAY, LABELS, VERDICTS, r6, red, verdicts

FIELDS = ("band", "event_type", "k")
INTRODUCED = C.ORIGIN + 21 * DAY
WAIT = 1000
LEVELS = (0.01, 0.05, 0.1, 0.2)

GROWN = f"""{VERDICTS}, {LABELS}, w0 AS (SELECT off, tm, substr(detector, 9) AS field, p, h FROM v, (VALUES ('band'), ('event_type'), ('k')) AS t(h) WHERE tm >= {C.BURN_IN}),
w1 AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY tm, off) AS rk FROM w0 WHERE field = h AND tm >= {INTRODUCED}),
w2 AS (SELECT h, off, tm, p, true AS a FROM w0 WHERE field <> h UNION ALL SELECT h, off, tm, p, rk > {WAIT} FROM w1),
w3 AS (SELECT h, t AS treatment, off, any_value(tm) AS tm, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM w2, (VALUES ('A'), ('B')) AS y(t) WHERE t = 'B' OR a GROUP BY h, t, off),
gt AS (SELECT *, least(1.0, exp(-x2 / 2) * (1 + CASE WHEN j > 1 THEN x2 / 2 ELSE 0 END + CASE WHEN j > 2 THEN x2 * x2 / 8 ELSE 0 END)) AS p FROM w3)"""


def _combined(spark, sf_dir):
    v = verdicts(spark, sf_dir).where(F.col("at") >= C.BURN_IN).withColumn("field", F.substring("detector", 9, 100))
    return W.held_out(v, FIELDS, INTRODUCED, WAIT)


@register("schema_growth_combination", f"WITH {GROWN} SELECT h, treatment, off, j, round(p, 6) AS p FROM gt")
def schema_growth_combination(spark, sf_dir):
    """Each event's combination with a field held out until day 21 (of data from day 14 on), which then joins at once (B) or after 1,000 of its verdicts (A)."""
    return _combined(spark, sf_dir).select("h", "treatment", "off", "j", r6("p", "p"))


@register(
    "schema_growth",
    f"""WITH {GROWN}, m AS (SELECT count(DISTINCT off) / count(DISTINCT tm // {DAY}) AS m FROM gt),
r AS (SELECT h, treatment, tm // {DAY} AS d, round(p, 9) AS q9, row_number() OVER g AS rk, sum(red) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit FROM gt JOIN lab USING (off) WINDOW g AS (PARTITION BY h, treatment, tm // {DAY} ORDER BY round(p, 9), off)),
c AS (SELECT h, treatment, d, q, max(CASE WHEN q9 <= rk * q / m THEN rk END) AS cut, max(CASE WHEN q9 <= rk * q / m THEN hit END) AS hits FROM r, m, (VALUES {', '.join(f'({q}::DOUBLE)' for q in LEVELS)}) AS l(q) GROUP BY ALL)
SELECT h, treatment, CASE WHEN d < {INTRODUCED // DAY} THEN 'pre' ELSE 'post' END AS era, q, count(*) AS days, CAST(coalesce(sum(cut), 0) AS BIGINT) AS discoveries, CAST(coalesce(sum(hits), 0) AS BIGINT) AS hits, round(1 - sum(hits) / sum(cut), 6) AS fdr FROM c GROUP BY ALL""",
)
def schema_growth(spark, sf_dir):
    """Discoveries and realised false discovery rate of both treatments, before and after a field is introduced."""
    who = C.events(spark, sf_dir).select("off", red().cast("int").alias("red"))
    x = W.discoveries(_combined(spark, sf_dir).join(who, "off"), C.day(), INTRODUCED // DAY, LEVELS)
    return x.select("h", "treatment", "era", "q", "days", "discoveries", "hits", r6("fdr", "fdr"))


@register(
    "field_information",
    """WITH e1 AS (SELECT event_type, json_extract_string(props, '$.k') AS k, CASE WHEN value > 60 THEN 'high' ELSE 'low' END AS level FROM events WHERE value IS NOT NULL),
p AS (SELECT 'event_type' AS f_a, 'k' AS f_b, event_type AS a, k AS b FROM e1 UNION ALL SELECT 'event_type', 'level', event_type, level FROM e1 UNION ALL SELECT 'k', 'level', k, level FROM e1),
c AS (SELECT f_a, f_b, a, b, count(*) AS c FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL), x AS (SELECT *, sum(c) OVER (PARTITION BY f_a, f_b, a) AS na, sum(c) OVER (PARTITION BY f_a, f_b, b) AS nb, sum(c) OVER (PARTITION BY f_a, f_b) AS n FROM c),
mi AS (SELECT f_a, f_b, sum(c / n * ln(c * n / (na::DOUBLE * nb))) AS mi FROM x GROUP BY ALL), y AS (SELECT f_a AS h, f_b AS o, mi FROM mi UNION ALL SELECT f_b, f_a, mi FROM mi)
SELECT h, o AS nearest, round(mi, 6) AS mi FROM y QUALIFY row_number() OVER (PARTITION BY h ORDER BY round(mi, 9) DESC, o) = 1""",
)
def field_information(spark, sf_dir):
    """For each field the other one that tells most of it: how far a held-out field is known from those that stay."""
    e = C.events(spark, sf_dir).where("value is not null")
    x = W.nearest_information(W.information(e, {"event_type": F.col("event_type"), "k": F.col("k"), "level": F.when(F.col("value") > 60, "high").otherwise("low")}))
    return x.select("h", "nearest", r6("mi", "mi"))
