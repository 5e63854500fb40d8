"""Scalar functions, field kinds, decomposition, and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalar as S
from ..plans import conform as C
from ..sources import delimited as D
from .base import BAND, DAY, EVENTS, HOUR, r6


@register("band", f"SELECT event_id AS off, {BAND.format(x='value')} AS band, {BAND.format(x='(-value)')} AS mirrored FROM events")
def band(spark, sf_dir):
    e = C.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("off"), S.band(F.col("value")).alias("band"), S.band(-F.col("value")).alias("mirrored"))


_TEXTS = "CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-' || event_id || '.5' WHEN 2 THEN event_id || 'e2' WHEN 3 THEN 'x' || event_id WHEN 4 THEN 'inf' ELSE '' END"


@register("parse_number", f"SELECT event_id AS off, CASE WHEN regexp_full_match({_TEXTS}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({_TEXTS} AS DOUBLE) END AS x FROM events")
def parse_number(spark, sf_dir):
    text = F.expr(_TEXTS.replace("VARCHAR", "STRING"))
    return C.read(spark, sf_dir, "events").select(F.col("event_id").alias("off"), S.parse_number(text).alias("x"))


_QUAD = "'10.' || (event_id % 300) || '.' || (user_id % 256) || '.' || (event_id % 7)"


@register("subnet24", f"SELECT event_id AS off, CASE WHEN event_id % 300 < 256 THEN '10.' || (event_id % 300) || '.' || (user_id % 256) || '.0/24' END AS net FROM events")
def subnet24(spark, sf_dir):
    return C.read(spark, sf_dir, "events").select(F.col("event_id").alias("off"), S.subnet24(F.expr(_QUAD)).alias("net"))


@register("parent_domain", "SELECT page_id, CASE WHEN len(string_split(h, '.')) >= 3 THEN substr(h, strpos(h, '.') + 1) END AS parent FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)")
def parent_domain(spark, sf_dir):
    return C.read(spark, sf_dir, "pages").select("page_id", S.parent_domain(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("parent"))


@register("major_version", "SELECT event_id AS off, CASE WHEN event_id % 3 < 2 THEN CAST(user_id % 9 AS VARCHAR) END AS major FROM events")
def major_version(spark, sf_dir):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat(user_id % 9, '.', event_id % 10, '.1-rc+b') WHEN 1 THEN concat(user_id % 9, '.', event_id % 10) ELSE concat('release ', user_id) END")
    return C.read(spark, sf_dir, "events").select(F.col("event_id").alias("off"), S.major_version(text).alias("major"))


@register("pair_value", "SELECT event_id AS off, 'event_type×k' AS field, event_type || chr(31) || json_extract_string(props, '$.k') AS v FROM events")
def pair_value(spark, sf_dir):
    e = C.events(spark, sf_dir)
    return e.select("off", S.pair_field(F.lit("k"), F.lit("event_type")).alias("field"), S.pair_value(F.lit("k"), F.col("k"), F.lit("event_type"), F.col("event_type")).alias("v"))


@register("clock_cells", f"WITH {EVENTS} SELECT off, round(2 * pi() * (tm % {DAY}) / {DAY}.0, 6) AS phase, lpad(CAST(tm // {HOUR} % 168 AS VARCHAR), 3, '0') AS cell, tm // {DAY} AS day, tm // {HOUR} AS hour FROM e")
def clock_cells(spark, sf_dir):
    at = F.col("at")
    return C.events(spark, sf_dir).select("off", r6(S.phase_of_day(at), "phase"), S.weekly_hour(at).alias("cell"), F.floor(at / DAY).alias("day"), F.floor(at / HOUR).alias("hour"))


@register("null_scale", "SELECT user_id AS ent, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN sqrt(2 * ln(ln(count(*)))) ELSE 0 END, 6) AS scale FROM events GROUP BY 1")
def null_scale(spark, sf_dir):
    n = C.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ent")).agg(F.count("*").alias("n"))
    return n.select("ent", "n", r6(S.null_scale(F.col("n")), "scale"))


@register("entity_sample")
def entity_sample(spark, sf_dir):
    """Entities whose FNV-1a hash is 0 modulo 4, and all with a labelled event."""
    from ..functions.special import fnv1a
    from .base import red

    ent = C.events(spark, sf_dir).groupBy(F.col("ent").cast("string").alias("ent")).agg(F.coalesce(F.max(red()), F.lit(False)).alias("labelled"))
    return ent.where(F.col("labelled") | (F.pmod(fnv1a("ent").cast("decimal(20,0)"), F.lit(4).cast("decimal(20,0)")) == 0)).select("ent", "labelled")


def kinds(e, source: str, fields: list[str]):
    """Kind of each field over the whole source: the rules in their fixed order and thresholds."""
    rows = e.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select("x.field", "x.v")
    s = rows.where("v is not null").groupBy("field").agg(F.count("*").alias("obs"), F.count(S.parse_number(F.col("v"))).alias("numeric"), F.countDistinct("v").alias("distinct"), F.min(F.lower("v")).alias("lo"), F.max(F.lower("v")).alias("hi"))
    return s.withColumn("kind", kind_rule()).withColumn("source", F.lit(source))


#: The pairs of words, in any case, that make a field boolean.
BOOLEAN_PAIRS = (
    ("true", "false"), ("t", "f"), ("yes", "no"), ("y", "n"), ("1", "0"), ("on", "off"), ("up", "down"), ("success", "fail"), ("success", "failure"), ("pass", "fail"),
    ("enabled", "disabled"), ("allow", "deny"), ("permit", "deny"), ("accept", "reject"), ("granted", "denied"), ("present", "absent"), ("active", "inactive"),
    ("logon", "logoff"), ("start", "end"),
)


def kind_rule():
    ratio, numeric = F.col("distinct") / F.col("obs"), F.col("numeric") >= 0.99 * F.col("obs")
    boolean = (F.col("distinct") == 2) & F.concat_ws("|", "lo", "hi").isin(["|".join(sorted(p)) for p in BOOLEAN_PAIRS])
    return (
        F.when(F.col("obs") < 50, "unknown").when(~numeric & (F.col("obs") >= 200) & (ratio >= 0.95), "identifier").when(boolean, "boolean")
        .when(numeric & (ratio <= 0.1), "discrete").when(numeric, "continuous").otherwise("categorical")
    )


_KIND = "CASE WHEN obs < 50 THEN 'unknown' WHEN numeric < 0.99 * obs AND obs >= 200 AND dist >= 0.95 * obs THEN 'identifier' WHEN numeric >= 0.99 * obs AND dist <= 0.1 * obs THEN 'discrete' WHEN numeric >= 0.99 * obs THEN 'continuous' ELSE 'categorical' END"
_NUM = "regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"


@register(
    "kind_inference",
    f"""WITH r AS (SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS field, unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS v FROM part),
s AS (SELECT field, count(*) AS obs, count(CASE WHEN {_NUM} THEN 1 END) AS numeric, count(DISTINCT v) AS dist FROM r WHERE v IS NOT NULL GROUP BY 1) SELECT field, obs, numeric, {_KIND} AS kind FROM s""",
)
def kind_inference(spark, sf_dir):
    return kinds(C.read(spark, sf_dir, "part"), "part", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).select("field", "obs", "numeric", "kind")


@register(
    "kind_timeline",
    f"""WITH {EVENTS}, x AS (SELECT off, k, row_number() OVER (ORDER BY tm, off) - 1 AS obs, row_number() OVER (PARTITION BY k ORDER BY tm, off) AS nth, tm FROM e0),
y AS (SELECT off, obs, coalesce(sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dist FROM x)
SELECT off, obs, CAST(dist AS BIGINT) AS seen, CASE WHEN obs < 50 THEN 'unknown' WHEN least(dist, 10000) <= 0.1 * obs THEN 'discrete' ELSE 'continuous' END AS kind FROM y""",
)
def kind_timeline(spark, sf_dir):
    """The kind of the numeric field k as each event finds it; counts are two-level prefix sums, distinct values are capped at 10,000."""
    e = C.events(spark, sf_dir).withColumn("first", (F.row_number().over(Window.partitionBy("k").orderBy("at", "off")) == 1).cast("long")).withColumn("source", F.lit("events"))
    x = C.running(e, ["source"], {"obs": F.lit(1).cast("long"), "seen": F.col("first")}, F.floor(F.col("at") / HOUR).cast("long"))
    kind = F.when(F.col("obs") < 50, "unknown").when(F.least("seen", F.lit(10_000)) <= 0.1 * F.col("obs"), "discrete").otherwise("continuous")
    return x.select("off", "obs", "seen", kind.alias("kind"))


@register("presence_posterior", "SELECT 'toxic' AS field, round((1 + count(l.toxic)) / (2.0 + count(*)), 6) AS mean, CASE WHEN (1 + count(l.toxic)) / (2.0 + count(*)) >= 0.5 THEN 'abstained_unexpected' ELSE 'abstained_structural' END AS absence FROM documents d LEFT JOIN labels l USING (doc_id)")
def presence_posterior(spark, sf_dir):
    """Beta(1, 1) posterior of a field's presence, and how its absence is then classed."""
    d = C.read(spark, sf_dir, "documents").select("doc_id").join(C.read(spark, sf_dir, "labels"), "doc_id", "left")
    m = (1 + F.count("toxic")) / (2.0 + F.count("*"))
    return d.agg(F.lit("toxic").alias("field"), r6(m, "mean"), F.when(m >= 0.5, "abstained_unexpected").otherwise("abstained_structural").alias("absence"))


@register(
    "decomposition",
    "WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) SELECT count(*) AS seen, count(CASE WHEN len(string_split(h, '.')) >= 3 THEN 1 END) AS domains, CASE WHEN count(*) >= 50 AND count(CASE WHEN len(string_split(h, '.')) >= 3 THEN 1 END) >= 0.95 * count(*) THEN 'parent_domain' END AS chosen FROM h",
)
def decomposition(spark, sf_dir):
    """The one decomposition that at least 95 % of 50 or more distinct values follow; more than one, or none, is none."""
    h = C.read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("h")).distinct()
    named = {"subnet24": S.subnet24, "parent_domain": S.parent_domain, "major_version": S.major_version}
    x = h.agg(F.count("*").alias("seen"), *(F.count(f(F.col("h"))).alias(n) for n, f in named.items()))
    fits = [F.when((F.col("seen") >= 50) & (F.col(n) >= 0.95 * F.col("seen")), n) for n in named]
    chosen = F.filter(F.array(*fits), lambda v: v.isNotNull())
    return x.select("seen", F.col("parent_domain").alias("domains"), F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))).alias("chosen"))


SCHEMA = D.Schema(source="events", columns=("time", "user", "action", "", "value"), time="time", entity="user", unit=1_000_000, missing="?", admit=r"^U\d")
_LINES = "concat_ws(',', unix_micros(cast(ts AS timestamp)) div 1000000, concat('U', user_id), if(event_id % 11 = 0, '?', event_type), 'x', if(event_id % 13 = 0, '', cast(event_id AS string)))"


def _lines(spark, sf_dir):
    """Some lines are short, some have a bad time, some no entity."""
    e = C.read(spark, sf_dir, "events")
    line = F.expr(f"CASE WHEN event_id % 97 = 0 THEN 'short,line' WHEN event_id % 89 = 0 THEN concat('t', {_LINES}) WHEN event_id % 83 = 0 THEN '5,?,a,x,1' WHEN event_id % 79 = 0 THEN '5,S1,a,x,1' ELSE {_LINES} END")
    return e.select(F.col("event_id").alias("offset"), line.alias("line"))


@register(
    "delimited_reader",
    f"""SELECT event_id AS "offset", 'U' || user_id AS entity, epoch_us(ts) // 1000000 * 1000000 AS tm, CASE WHEN event_id % 11 <> 0 THEN event_type END AS action, event_id % 11 = 0 AS unusable, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id AS VARCHAR) END AS value
FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 AND event_id % 79 <> 0""",
)
def delimited_reader(spark, sf_dir):
    """Lines to events: columns by schema, empty means absent, the missing token means present but unusable."""
    good, _ = D.parse(_lines(spark, sf_dir), SCHEMA)
    f = F.col("fields")
    return good.select("offset", "entity", F.col("at").alias("tm"), F.when(f["action"]["usable"], f["action"]["text"]).alias("action"), (~f["action"]["usable"]).alias("unusable"), F.when(f["value"]["usable"], f["value"]["text"]).alias("value"))


@register(
    "row_errors",
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 97 = 0 THEN 'columns' WHEN event_id % 89 = 0 THEN 'time' WHEN event_id % 83 = 0 THEN 'filtered' WHEN event_id % 79 = 0 THEN 'filtered' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY 1",
)
def row_errors(spark, sf_dir):
    """What the reader sets aside, by reason."""
    return D.parse(_lines(spark, sf_dir), SCHEMA)[1].groupBy("reason").agg(F.count("*").alias("n"))
