"""One table of verdicts of all arms that SQL can follow, and what is read from it: combination, substitution, ablation, control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..operators import arms as A
from ..operators import combine as K
from ..operators import novelty as N
from ..operators import rates as R
from ..plans import conform as C
from .base import DAY, EVENTS, HOUR, LABELS, VERDICTS, novelty_ctes, r6, settled_events, verdicts
from .ranking import _labels

#: Arms on the whole population, which say nothing of one entity.
POPULATION_ARMS = ("marginal_event_type",)

_CELL = f"lpad(CAST(CAST(floor(tm / {HOUR}.0) AS BIGINT) % 168 AS VARCHAR), 3, '0')"

ALL_ARMS = f"""{VERDICTS}, {novelty_ctes('cg', _CELL)},
{novelty_ctes('pa', "event_type || chr(31) || k")}, {novelty_ctes('pb', "band || chr(31) || event_type")}, {novelty_ctes('pc', "band || chr(31) || k")},
pairs AS (SELECT off, any_value(ent) AS ent, any_value(tm) AS tm, CASE WHEN min(p) >= 1 THEN 1 ELSE 1 - pow(1 - min(p), count(*)) END AS p FROM (SELECT off, ent, tm, p FROM pa_p UNION ALL SELECT off, ent, tm, p FROM pb_p UNION ALL SELECT off, ent, tm, p FROM pc_p) GROUP BY off),
mr AS (SELECT off, ent, tm, event_type AS v, wt FROM e WHERE known), mu AS (SELECT DISTINCT v AS u FROM mr),
mm AS (SELECT off, ent, tm, v, u, coalesce(sum(CASE WHEN v = u THEN wt END) OVER f, 0.0) / wt AS n_u, count(CASE WHEN v = u THEN 1 END) OVER f AS seen FROM mr CROSS JOIN mu WINDOW f AS (PARTITION BY u ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mo AS (SELECT off, any_value(ent) AS ent, any_value(tm) AS tm, sum(n_u) AS n, count(CASE WHEN seen > 0 THEN 1 END) AS k, coalesce(max(CASE WHEN u = v AND seen > 0 THEN n_u END), 0.0) AS n_v, max(CASE WHEN u = v AND seen > 0 THEN 1 ELSE 0 END) AS ws FROM mm GROUP BY off),
mt AS (SELECT mm.off, sum(n_u + 1) AS s FROM mm JOIN mo USING (off) WHERE seen > 0 AND n_u <= n_v GROUP BY mm.off),
av AS (SELECT off, ent, tm, detector, 'evaluated' AS status, false AS shadow, p FROM v
 UNION ALL SELECT off, ent, tm, 'cellgrid', 'evaluated', true, p FROM cg_p
 UNION ALL SELECT off, ent, tm, 'pairing', 'evaluated', false, p FROM pairs
 UNION ALL SELECT off, ent, tm, 'marginal_event_type', CASE WHEN n >= 1000 THEN 'evaluated' ELSE 'abstained_structural' END, false,
   CASE WHEN n >= 1000 THEN CASE WHEN ws = 0 THEN 1 / (n + k + 1) ELSE least(1.0, (coalesce(s, 0) + 1) / (n + k + 1)) END END FROM mo LEFT JOIN mt USING (off))"""


def all_arms(spark, sf_dir) -> DataFrame:
    """off, ent, at, detector, status, shadow and p (null where the arm abstains); a shadow arm is scored, but enters no combination."""
    return A.table(spark, sf_dir).select("off", "ent", "at", "detector", "status", "shadow", "p")


@register("verdict_table", f"WITH {ALL_ARMS} SELECT off, ent, detector, status, shadow, round(p, 6) AS p FROM av")
def verdict_table(spark, sf_dir):
    """Every arm's verdict on every settled event."""
    return all_arms(spark, sf_dir).select("off", "ent", "detector", "status", "shadow", r6("p", "p"))


_TAIL = "least(1.0, exp(-x2 / 2) * list_sum(list_transform(range(0, j), lambda i: pow(x2 / 2, i) / factorial(CAST(i AS INTEGER)))))"


@register("fisher_all_arms", f"WITH {ALL_ARMS}, c AS (SELECT off, any_value(ent) AS ent, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM av WHERE status = 'evaluated' AND NOT shadow GROUP BY off) SELECT off, ent, j, round(x2, 6) AS x2, round({_TAIL}, 6) AS p FROM c")
def fisher_all_arms(spark, sf_dir):
    """Fisher's combination of every arm that is evaluated and no shadow."""
    x = all_arms(spark, sf_dir).where("status = 'evaluated' and not shadow").groupBy("off").agg(F.first("ent").alias("ent"), F.count("*").alias("j"), F.sum(-2 * F.log("p")).alias("x2"))
    # the tail first: in one select, its lambda would read the rounded x2 beside it
    return x.withColumn("p", S.fisher_tail(F.col("x2"), F.col("j"))).select("off", "ent", "j", r6("x2", "x2"), r6("p", "p"))


@register("verdict_census", f"WITH {ALL_ARMS} SELECT detector, shadow, count(CASE WHEN status = 'evaluated' THEN 1 END) AS evaluated, count(CASE WHEN status <> 'evaluated' THEN 1 END) AS abstained, count(CASE WHEN (status = 'evaluated') <> (p IS NOT NULL AND p > 0 AND p <= 1) THEN 1 END) AS faults FROM av GROUP BY 1, 2")
def verdict_census(spark, sf_dir):
    """Verdicts by arm and status; a fault is an evaluated verdict without a p in (0, 1], or an abstention with one."""
    sound = F.coalesce(F.col("p").isNotNull() & (F.col("p") > 0) & (F.col("p") <= 1), F.lit(False))
    said = F.col("status") == "evaluated"
    return all_arms(spark, sf_dir).groupBy("detector", "shadow").agg(F.count_if(said).alias("evaluated"), F.count_if(~said).alias("abstained"), F.count_if(said != sound).alias("faults"))


@register(
    "evidence_reconstruction",
    f"""WITH {ALL_ARMS} SELECT detector, count(CASE WHEN status = 'evaluated' THEN 1 END) AS whole, count(CASE WHEN status <> 'evaluated' THEN 1 END) AS partial, 0::BIGINT AS failed, count(CASE WHEN status <> 'evaluated' THEN 1 END) AS history FROM av GROUP BY 1""",
)
def evidence_reconstruction(spark, sf_dir):
    """By arm: verdicts whose p follows from their evidence alone, abstentions (nothing to compute), and verdicts that do not follow."""
    x = A.table(spark, sf_dir).withColumn("again", A.recomputed())
    said = F.col("status") == "evaluated"
    same = F.coalesce(F.abs(F.col("again") - F.col("p")) <= 1e-12 * F.col("p"), F.lit(False))
    return x.groupBy("detector").agg(F.count_if(said & same).alias("whole"), F.count_if(~said).alias("partial"), F.count_if(said & ~same).alias("failed"), F.count_if(F.col("cause") == "history").alias("history"))


@register(
    "substituted_arm",
    f"""WITH {VERDICTS}, {novelty_ctes('cg', _CELL)}, w AS (SELECT 0 AS s, off, p FROM v UNION ALL SELECT 1, off, p FROM v WHERE detector <> 'novelty_band' UNION ALL SELECT 1, off, p FROM cg_p),
c AS (SELECT s, off, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM w GROUP BY s, off), t AS (SELECT s, off, {_TAIL} AS p FROM c)
SELECT off, round(max(CASE WHEN s = 0 THEN p END), 6) AS p, round(max(CASE WHEN s = 1 THEN p END), 6) AS substituted FROM t GROUP BY off""",
)
def substituted_arm(spark, sf_dir):
    """Fisher's combination as it is, and with the shadow cellgrid in the place of the band's novelty."""
    v = verdicts(spark, sf_dir).select("off", "detector", "p")
    both = v.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).where("s = 0 or detector <> 'novelty_band'").select("s", "off", "p")
    x = both.unionByName(all_arms(spark, sf_dir).where("detector = 'cellgrid'").select(F.lit(1).alias("s"), "off", "p"))
    g = x.groupBy("off").agg(*(F.count(F.when(F.col("s") == s, 1)).alias(f"j{s}") for s in (0, 1)), *(F.sum(F.when(F.col("s") == s, -2 * F.log("p"))).alias(f"x{s}") for s in (0, 1)))
    return g.select("off", *(r6(S.fisher_tail(F.col(f"x{s}"), F.col(f"j{s}")), name) for s, name in ((0, "p"), (1, "substituted"))))


@register(
    "entity_scope",
    f"""WITH {ALL_ARMS} SELECT ent, CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, count(DISTINCT off) AS events, round(min(p), 6) AS best, count(DISTINCT CASE WHEN round(p, 9) <= 0.05 THEN off END) AS below
FROM av WHERE NOT shadow AND status = 'evaluated' AND detector NOT IN ({', '.join(f"'{a}'" for a in POPULATION_ARMS)}) GROUP BY 1, 2""",
)
def entity_scope(spark, sf_dir):
    """Entity-days over the arms that speak of one entity: events, the best p, and events with any p up to 0.05."""
    x = all_arms(spark, sf_dir).where((F.col("status") == "evaluated") & ~F.col("shadow") & ~F.col("detector").isin(*POPULATION_ARMS))
    events = x.groupBy("ent", C.day().alias("d"), "off").agg(F.min("p").alias("p"))
    return events.groupBy("ent", "d").agg(F.count("*").alias("events"), F.round(F.min("p"), 6).alias("best"), F.count_if(F.round("p", 9) <= 0.05).alias("below"))


@register(
    "within_run_control",
    f"""WITH {ALL_ARMS}, {LABELS} SELECT detector, alpha, count(*) AS nulls, count(CASE WHEN round(p, 9) <= alpha THEN 1 END) AS below, round(count(CASE WHEN round(p, 9) <= alpha THEN 1 END) / (alpha * count(*)), 6) AS ratio
FROM av JOIN lab USING (off), (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) AS t(alpha) WHERE red = 0 AND status = 'evaluated' AND tm >= {C.BURN_IN} GROUP BY 1, 2""",
)
def within_run_control(spark, sf_dir):
    """Which arm breaks control: of unlabelled events after burn-in, the share with p up to alpha, over alpha."""
    x = all_arms(spark, sf_dir).where((F.col("status") == "evaluated") & (F.col("at") >= C.BURN_IN)).join(_labels(spark, sf_dir).where("red = 0"), "off")
    levels = (0.01, 0.05, 0.1)
    g = x.groupBy("detector").agg(F.count("*").alias("nulls"), *(F.count_if(F.round("p", 9) <= a).alias(f"b{i}") for i, a in enumerate(levels)))
    g = g.select("detector", "nulls", F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.col(f"b{i}").alias("below")) for i, a in enumerate(levels)))).alias("l"))
    return g.select("detector", "l.alpha", "nulls", "l.below", r6(F.col("l.below") / (F.col("l.alpha") * F.col("nulls")), "ratio"))


@register(
    "paired_ablation",
    f"""WITH {VERDICTS}, {LABELS}, c AS (SELECT dropped, off, any_value(ent) AS ent, any_value(tm) AS tm, count(*) AS j, sum(-2 * ln(p)) AS x2 FROM v, (VALUES ('none'), ('novelty_band'), ('novelty_event_type'), ('novelty_k')) AS t(dropped) WHERE detector <> dropped AND tm >= {C.BURN_IN} GROUP BY dropped, off),
r AS (SELECT dropped, off, row_number() OVER (PARTITION BY dropped, tm // {DAY} ORDER BY round({_TAIL}, 9), tm, ent, off) AS rank FROM c), a AS (SELECT dropped, off FROM r WHERE rank <= 20)
SELECT a.dropped, count(*) AS alerts, CAST(sum(red) AS BIGINT) AS hits, count(b.off) AS shared FROM a JOIN lab USING (off) LEFT JOIN (SELECT off FROM a WHERE dropped = 'none') b USING (off) GROUP BY 1""",
)
def paired_ablation(spark, sf_dir):
    """The daily twenty of the composite with each arm left out: alerts, labelled events among them, and alerts shared with the full composite."""
    v = verdicts(spark, sf_dir).where(F.col("at") >= C.BURN_IN)
    dropped = F.explode(F.array(*map(F.lit, ("none", "novelty_band", "novelty_event_type", "novelty_k"))))
    c = v.withColumn("dropped", dropped).where("detector <> dropped").groupBy("dropped", "off").agg(F.first("ent").alias("ent"), F.first("at").alias("at"), F.count("*").alias("j"), F.sum(-2 * F.log("p")).alias("x2"))
    c = c.withColumn("d", C.day()).withColumn("a", F.round(S.fisher_tail(F.col("x2"), F.col("j")), 9)).withColumn("set", F.col("dropped"))
    a = K.top_per_day(c, 20, ["a", "at", "ent", "off"], by=("set", "d")).select("dropped", "off")
    full = a.where("dropped = 'none'").select("off", F.lit(1).alias("full"))
    return a.join(full, "off", "left").join(_labels(spark, sf_dir), "off").groupBy("dropped").agg(F.count("*").alias("alerts"), F.sum("red").alias("hits"), F.count("full").alias("shared"))


@register("history_product", f"""WITH {EVENTS}, {novelty_ctes('x', 'k')} SELECT CAST(floor(tm / {DAY}.0) AS BIGINT) AS d, count(*) AS events, {', '.join(f"round(quantile_cont(p * (n + k + 1), {q / 100}), 6) AS q{q}" for q in (10, 50, 90))} FROM x_p GROUP BY 1""")
def history_product(spark, sf_dir):
    """By day, quantiles of p times the history's mass: near 1 means that an arm gives its floor, which falls as history grows."""
    x = N.dirichlet(settled_events(spark, sf_dir), "k").select(C.day().alias("d"), (F.col("p") * (F.col("n") + F.col("k") + 1)).alias("x"))
    return x.groupBy("d").agg(F.count("*").alias("events"), *(F.round(F.percentile("x", F.lit(q / 100)), 6).alias(f"q{q}") for q in (10, 50, 90)))


_TAU = 20.0


@register(
    "moment_blending",
    f"""WITH {EVENTS}, m AS (SELECT ent, sum(wt) AS w, sum(wt * cos(2 * pi() * (tm % {DAY}) / {DAY}.0)) AS c, sum(wt * sin(2 * pi() * (tm % {DAY}) / {DAY}.0)) AS s FROM e GROUP BY ent), z AS (SELECT max(wt) AS z FROM e),
o AS (SELECT ent, w / z AS w, c / z AS c, s / z AS s FROM m, z), p AS (SELECT sum(w) AS pw, sum(c) AS pc, sum(s) AS ps FROM o), b AS (SELECT *, w / (w + {_TAU}) AS own FROM o, p)
SELECT ent, round(own, 6) AS own, round(own * w + (1 - own) * pw, 6) AS w, round(own * c + (1 - own) * pc, 6) AS c1, round(own * s + (1 - own) * ps, 6) AS s1 FROM b""",
)
def moment_blending(spark, sf_dir):
    """Each entity's first circular moments, shrunk towards the population's by its own decayed weight."""
    w, phase = C.weight(F.col("at")), S.phase_of_day(F.col("at"))
    m = C.events(spark, sf_dir).groupBy("ent").agg(F.sum(w).alias("w"), F.sum(w * F.cos(phase)).alias("c"), F.sum(w * F.sin(phase)).alias("s"), F.max(w).alias("last"))
    parent = m.agg(F.max("last").alias("z"), *(F.sum(x).alias(f"p{x}") for x in "wcs"))
    x = m.crossJoin(F.broadcast(parent))  # a single row
    own = (F.col("w") / F.col("z")) / (F.col("w") / F.col("z") + _TAU)
    mix = lambda v: (own * F.col(v) + (1 - own) * F.col(f"p{v}")) / F.col("z")
    return x.select("ent", r6(own, "own"), r6(mix("w"), "w"), r6(mix("c"), "c1"), r6(mix("s"), "s1"))


@register(
    "block_lambda",
    f"""WITH {EVENTS}, x AS (SELECT 't:' || event_type AS a, 'k:' || k AS b, sum(wt) AS w FROM e WHERE k IS NOT NULL GROUP BY ALL), x2 AS (SELECT a, b, w / (SELECT max(wt) FROM e) AS w FROM x),
deg AS (SELECT node, sum(w) AS deg FROM (SELECT a AS node, w FROM x2 UNION ALL SELECT b, w FROM x2) GROUP BY node), tot AS (SELECT 2 * sum(w) AS total FROM x2),
blk AS (SELECT node, CASE WHEN node LIKE 't:%' THEN 't' || length(node) % 2 WHEN length(node) < 4 THEN NULL ELSE 'k' || (TRY_CAST(substr(node, 3) AS INTEGER) % 3) END AS block FROM deg),
bd AS (SELECT block, sum(deg) AS d FROM deg JOIN blk USING (node) WHERE block IS NOT NULL GROUP BY block),
j AS (SELECT x2.*, da.deg AS k_a, db.deg AS k_b, ba.block AS r, bb.block AS s FROM x2 JOIN deg da ON da.node = a JOIN deg db ON db.node = b JOIN blk ba ON ba.node = a JOIN blk bb ON bb.node = b),
mw AS (SELECT r, s, sum(w) AS m FROM j WHERE r IS NOT NULL AND s IS NOT NULL GROUP BY r, s)
SELECT a, b, round(w, 6) AS w, round(k_a * k_b / total * CASE WHEN j.r IS NULL OR j.s IS NULL THEN 1 ELSE m * total / (dr.d * ds.d) END, 6) AS lam, j.r IS NULL OR j.s IS NULL AS fallback
FROM j CROSS JOIN tot LEFT JOIN mw ON mw.r = j.r AND mw.s = j.s LEFT JOIN bd dr ON dr.block = j.r LEFT JOIN bd ds ON ds.block = j.s""",
)
def block_lambda(spark, sf_dir):
    """Expected weights of the graph of event types and values of k under a stated partition; values of one digit have no block and take the configuration model."""
    e = C.events(spark, sf_dir).where("k is not null")
    top = C.events(spark, sf_dir).agg(F.max(C.weight(F.col("at"))).alias("top"))
    edges = e.groupBy(F.concat(F.lit("t:"), "event_type").alias("a"), F.concat(F.lit("k:"), "k").alias("b")).agg(F.sum(C.weight(F.col("at"))).alias("w"))
    edges = edges.crossJoin(F.broadcast(top)).select("a", "b", (F.col("w") / F.col("top")).alias("w"))  # a single row
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    block = F.when(F.col("node").startswith("t:"), F.concat(F.lit("t"), F.length("node") % 2)).when(F.length("node") >= 4, F.concat(F.lit("k"), F.expr("try_cast(substr(node, 3) as int) % 3")))
    x = R.block_lambda(edges, nodes.select("node", block.alias("block")).where("block is not null"))
    return x.select("a", "b", r6("w", "w"), r6("lam", "lam"), "fallback")


@register(
    "augmented_fields",
    f"""WITH {EVENTS}, f AS (SELECT off, 'event_type' AS field, event_type AS text FROM e UNION ALL SELECT off, 'k', k FROM e UNION ALL SELECT off, 'value×band', band FROM e
 UNION ALL SELECT off, 'k×parity', CASE TRY_CAST(k AS INTEGER) % 2 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' END FROM e UNION ALL SELECT off, 'ts×cell', {_CELL} FROM e)
SELECT off, field, split_part(field, '×', 1) AS parent, CASE WHEN contains(field, '×') THEN split_part(field, '×', 2) END AS derivation, text FROM f WHERE text IS NOT NULL""",
)
def augmented_fields(spark, sf_dir):
    """Each event's fields with those derived from them, before scoring; what cannot be parsed is absent."""
    number = F.expr("try_cast(k as int)")
    fields: dict[str, Column] = {
        "event_type": F.col("event_type"), "k": F.col("k"), S.derived("value", "band"): F.col("band"),
        S.derived("k", "parity"): F.when(number % 2 == 0, "even").when(number % 2 == 1, "odd"), S.derived("ts", "cell"): S.weekly_hour(F.col("at")),
    }
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in fields.items())))
    x = C.events(spark, sf_dir).select("off", long.alias("f")).select("off", "f.field", "f.text").where("text is not null")
    return x.select("off", "field", S.parent_of(F.col("field")).alias("parent"), S.derivation_of(F.col("field")).alias("derivation"), "text")
