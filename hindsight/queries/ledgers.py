"""Daily queues written as ledgers, and what is read from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..operators import arms as A
from ..operators import weighted as W
from ..plans import conform as C
from ..plans.store import shared_folder
from ..sources import ledger
from .allarms import _TAIL, ALL_ARMS
from .base import DAY, LABELS, VERDICTS, fused, r6, red, verdicts

BUDGET = 20


def _written(spark, ranked):
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.write(ranked, path)
    return ledger.read(spark, path)


def _three(spark, sf_dir):
    own = verdicts(spark, sf_dir).select(F.col("detector").alias("arm"), C.day().alias("d"), "off", "ent", "at", "p")
    return own.unionByName(fused(spark, sf_dir).select(F.lit("fisher").alias("arm"), "d", "off", "ent", "at", F.col("fisher_p").alias("p")))


def _six(spark, sf_dir):
    x = A.table(spark, sf_dir).where("status = 'evaluated' and not shadow")
    all_of_them = x.groupBy("off", "ent", "at", "d").agg(F.count("*").alias("j"), F.sum(-2 * F.col("ln_p")).alias("x2"))
    fisher = all_of_them.withColumn("p", S.fisher_tail(F.col("x2"), F.col("j"))).select(F.lit("fisher").alias("arm"), "d", "off", "ent", "at", "p")
    return x.select(F.col("detector").alias("arm"), "d", "off", "ent", "at", "p").unionByName(fisher)


_QUEUE = """{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, d ORDER BY round(ln(p), 9), tm, ent, off) AS rank FROM {of}) WHERE rank <= {budget})"""
_THREE = f"""fc AS (SELECT off, any_value(ent) AS ent, any_value(tm) AS tm, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM v GROUP BY off),
three AS (SELECT detector AS arm, off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, p FROM v UNION ALL SELECT 'fisher', off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT), {_TAIL} FROM fc)"""


@register("ledger_alerts", f"WITH {VERDICTS}, {_THREE}, {_QUEUE.format(n='q', of='three', budget=BUDGET)} SELECT arm, d, rank, off, round(p, 6) AS p FROM q WHERE tm >= {C.BURN_IN} AND rank <= 10")
def ledger_alerts(spark, sf_dir):
    """The first ten of each arm and day of the scoring phase, read from a ledger that was written."""
    x = _written(spark, ledger.queues(_three(spark, sf_dir), BUDGET, C.BURN_IN))
    return x.where("phase = 'scoring' and rank <= 10").select("arm", "d", F.col("rank").cast("long").alias("rank"), "off", r6("p", "p"))


@register(
    "ledger_difference",
    f"""WITH {ALL_ARMS}, {_THREE}, sc AS (SELECT off, any_value(ent) AS ent, any_value(tm) AS tm, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM av WHERE status = 'evaluated' AND NOT shadow GROUP BY off),
six AS (SELECT detector AS arm, off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, p FROM av WHERE status = 'evaluated' AND NOT shadow UNION ALL SELECT 'fisher', off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT), {_TAIL} FROM sc),
{_QUEUE.format(n='qa', of='three', budget=BUDGET)}, {_QUEUE.format(n='qb', of='six', budget=BUDGET)},
j AS (SELECT arm, coalesce(a.tm, b.tm) AS tm, a.rank AS ra, b.rank AS rb FROM qa a FULL JOIN qb b USING (arm, d, off))
SELECT CASE WHEN tm < {C.BURN_IN} THEN 'burn_in' ELSE 'scoring' END AS phase, arm, count(CASE WHEN rb IS NULL THEN 1 END) AS only_a, count(CASE WHEN ra IS NULL THEN 1 END) AS only_b, count(CASE WHEN ra <> rb THEN 1 END) AS moved FROM j GROUP BY 1, 2""",
)
def ledger_difference(spark, sf_dir):
    """Two ledgers against each other: three arms and their combination, and all arms that are no shadow with theirs."""
    a, b = (_written(spark, ledger.queues(x, BUDGET, C.BURN_IN)) for x in (_three(spark, sf_dir), _six(spark, sf_dir)))
    return ledger.difference(a, b)


DEPTH = 100

_LOGLIK = "(observed * ln({a}) + ({a} - 1) * coalesce(s, 0) + CASE WHEN censored > 0 THEN censored * ln(1 - exp({a} * most)) ELSE 0 END)"
_THIRD = "observed > 0 AND " + _LOGLIK.format(a="(lo + (hi - lo) / 3)") + " < " + _LOGLIK.format(a="(hi - (hi - lo) / 3)")
_WEIGHTED = f"""s AS (SELECT detector AS arm, off, ent, tm, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, round(ln(p), 9) AS lp, red = 1 AS red FROM av JOIN lab USING (off) WHERE status = 'evaluated' AND NOT shadow),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arm, d ORDER BY lp, tm, ent, off) AS rank FROM s) WHERE rank <= {DEPTH}), past AS (SELECT * FROM q WHERE tm < {C.BURN_IN}),
tot AS (SELECT arm, count(*) AS total FROM s WHERE tm < {C.BURN_IN} GROUP BY 1), o AS (SELECT arm, lp, row_number() OVER (PARTITION BY arm ORDER BY lp) AS i FROM past), th AS (SELECT arm, max(lp) AS threshold FROM o WHERE i <= 200 GROUP BY 1),
sc AS (SELECT arm, threshold, coalesce(avg(CASE WHEN lp < threshold THEN threshold - lp END), 0) AS scale FROM o JOIN th USING (arm) WHERE i <= 200 GROUP BY 1, 2), atc AS (SELECT arm, count(*) AS retained, count(CASE WHEN lp <= threshold THEN 1 END) AS at_ FROM past JOIN th USING (arm) GROUP BY 1),
tail AS (SELECT * FROM sc JOIN atc USING (arm) JOIN tot USING (arm) WHERE retained > 1), cum AS (SELECT arm, lp, sum(count(*)) OVER (PARTITION BY arm ORDER BY lp) AS c FROM past GROUP BY arm, lp),
lq AS (SELECT q.*, CASE WHEN q.lp < threshold AND scale > 0 THEN ln(at_ / total) - (threshold - q.lp) / scale WHEN c IS NULL THEN -ln(total) ELSE ln(c / total) END AS lq FROM (q JOIN tail USING (arm)) q ASOF LEFT JOIN cum ON q.arm = cum.arm AND q.lp >= cum.lp),
seen AS (SELECT arm, max(lq) AS most, count(CASE WHEN red THEN 1 END) AS observed, sum(CASE WHEN red THEN lq END) AS s FROM lq WHERE tm < {C.BURN_IN} GROUP BY 1),
miss AS (SELECT arm, count(*) AS censored FROM s WHERE red AND tm < {C.BURN_IN} AND NOT EXISTS (SELECT 1 FROM past WHERE past.arm = s.arm AND past.off = s.off) GROUP BY 1),
x AS (SELECT arm, threshold, scale, most, observed, seen.s AS s, coalesce(censored, 0) AS censored FROM tail JOIN seen USING (arm) LEFT JOIN miss USING (arm)),
fit AS (WITH RECURSIVE t(arm, i, lo, hi) AS (SELECT arm, 0, 1e-6::DOUBLE, 1.0::DOUBLE FROM x UNION ALL SELECT t.arm, i + 1, CASE WHEN {_THIRD} THEN lo + (hi - lo) / 3 ELSE lo END, CASE WHEN {_THIRD} THEN hi ELSE hi - (hi - lo) / 3 END FROM t JOIN x USING (arm) WHERE i < 200) SELECT arm, (lo + hi) / 2 AS a FROM t WHERE i = 200),
w AS (SELECT x.*, CASE WHEN observed > 0 THEN 2 * ({_LOGLIK.format(a='a')} - {_LOGLIK.format(a='1.0')}) ELSE 0 END AS deviance, a AS best FROM x JOIN fit USING (arm)), wt AS (SELECT *, CASE WHEN deviance > 2.706 THEN best ELSE 1.0 END AS a FROM w)"""


def _weighted(spark, sf_dir):
    x = A.table(spark, sf_dir).where("status = 'evaluated' and not shadow").select(F.col("detector").alias("arm"), "d", "off", "ent", "at", F.round("ln_p", 9).alias("lp"))
    x = x.join(C.events(spark, sf_dir).select("off", red().alias("red")), "off")
    order = Window.partitionBy("arm", "d").orderBy("lp", "at", "ent", "off")
    queues = x.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= DEPTH).drop("_r")
    early = F.col("at") < C.BURN_IN
    past = queues.where(early)
    tail = W.tails(past, x.where(early).groupBy("arm").agg(F.count("*").alias("total")))
    placed = W.quantiles(queues, past, tail)
    fits = W.weights(placed.where(early), x.where(early & F.col("red")).select("arm", "off"), tail)
    return placed.where(~early), fits


@register("arm_weights", f"WITH {ALL_ARMS}, {LABELS}, {_WEIGHTED} SELECT arm, observed, censored, round(threshold, 6) AS threshold, round(scale, 6) AS scale, round(a, 5) AS a, round(deviance, 5) + 0.0 AS deviance FROM wt")
def arm_weights(spark, sf_dir):
    """Each arm's tail and the weight of its quantiles, learned from the burn-in's queues and labels."""
    _, fits = _weighted(spark, sf_dir)
    return fits.select("arm", "observed", "censored", r6("threshold", "threshold"), r6("scale", "scale"), F.round("a", 5).alias("a"), (F.round("deviance", 5) + 0.0).alias("deviance"))


@register(
    "weighted_queue",
    f"""WITH {ALL_ARMS}, {LABELS}, {_WEIGHTED}, z AS (SELECT lq.*, round(CASE WHEN wt.a >= 1 THEN 0 ELSE ln(wt.a) + (wt.a - 1) * least(lq, 0) END, 9) AS score FROM lq JOIN wt USING (arm) WHERE tm >= {C.BURN_IN}),
b AS (SELECT d, off, ent, tm, max(score) AS score FROM z GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, tm, ent, off) AS rank FROM b) SELECT d, rank, off, round(score, 5) AS score FROM r WHERE rank <= 20""",
)
def weighted_queue(spark, sf_dir):
    """Twenty alerts a day of all arms together, by likelihood ratio."""
    late, fits = _weighted(spark, sf_dir)
    return W.queue(late, fits, BUDGET).select("d", F.col("rank").cast("long").alias("rank"), "off", F.round("score", 5).alias("score"))
