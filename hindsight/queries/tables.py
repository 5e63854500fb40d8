"""Verdict algebra, second sources and state reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import rates as R
from ..plans import conform as C
from .base import DAY, VERDICTS, r6, verdicts


@register("verdict_counts", f"WITH {VERDICTS}, s AS (SELECT detector, CASE WHEN round(p, 9) < 1 THEN 'evaluated' ELSE 'cold' END AS status FROM v) SELECT detector, status, count(*) AS n FROM s GROUP BY 1, 2")
def verdict_counts(spark, sf_dir):
    return verdicts(spark, sf_dir).select("detector", F.when(F.round("p", 9) < 1, "evaluated").otherwise("cold").alias("status")).groupBy("detector", "status").agg(F.count("*").alias("n"))


@register("event_digest", "SELECT event_id AS off, sha256(concat('6:events', length(CAST(user_id AS VARCHAR)), ':', user_id, epoch_us(ts), '|event_type=', length(event_type), ':', event_type, '|k=', length(json_extract_string(props, '$.k')), ':', json_extract_string(props, '$.k'))) AS digest FROM events")
def event_digest(spark, sf_dir):
    """An event's identity: a digest over length-prefixed source, entity, time and sorted fields; the order within a time is no part of it."""
    sized = lambda c: F.concat(F.char_length(c).cast("string"), F.lit(":"), c)
    ent = F.col("ent").cast("string")
    text = F.concat(F.lit("6:events"), sized(ent), F.col("at").cast("string"), F.lit("|event_type="), sized(F.col("event_type")), F.lit("|k="), sized(F.col("k")))
    return C.events(spark, sf_dir).select("off", F.sha2(text, 256).alias("digest"))


@register("state_report", "SELECT count(DISTINCT user_id) AS entities, count(DISTINCT (user_id, event_type)) AS value_rows, count(DISTINCT (event_type, json_extract_string(props, '$.k'))) AS edges FROM events")
def state_report(spark, sf_dir):
    return C.events(spark, sf_dir).agg(F.countDistinct("ent").alias("entities"), F.countDistinct("ent", "event_type").alias("value_rows"), F.countDistinct("event_type", "k").alias("edges"))


@register("graph_edges", f"WITH e AS (SELECT event_type AS a, json_extract_string(props, '$.k') AS b, epoch_us(ts) AS tm FROM events), l AS (SELECT max(tm) AS last FROM e) SELECT a, b, round(sum(pow(2.0, (tm - last) / {float(C.HALF_LIFE)})), 6) AS weight FROM e CROSS JOIN l GROUP BY 1, 2")
def graph_edges(spark, sf_dir):
    """Edges of the co-occurrence graph with their weights at the end of the stream."""
    e = C.events(spark, sf_dir)
    last = e.agg(F.max("at").alias("last"))
    w = F.sum(F.pow(F.lit(2.0), (F.col("at") - F.col("last")) / float(C.HALF_LIFE)))
    return e.crossJoin(F.broadcast(last)).groupBy(F.col("event_type").alias("a"), F.col("k").alias("b")).agg(r6(w, "weight"))


_ORD = "SELECT o_orderkey AS off, o_custkey AS ent, epoch_us(o_orderdate) AS tm, o_orderpriority AS v FROM orders"


@register(
    "orders_decayed",
    f"WITH e AS ({_ORD}) SELECT off, ent, v, round(coalesce(sum(pow(2.0, tm / {float(90 * DAY)} - 100)) OVER f, 0.0) / pow(2.0, tm / {float(90 * DAY)} - 100), 5) AS n, count(*) OVER f AS raw FROM e WINDOW f AS (PARTITION BY ent, v ORDER BY tm, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def orders_decayed(spark, sf_dir):
    """A second source with many tied times: decayed counts of a customer's order priorities, half-life 90 days."""
    o = C.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("off"), F.col("o_custkey").alias("ent"), C.micros(F.col("o_orderdate")).alias("at"), F.col("o_orderpriority").alias("v"))
    own, f = F.pow(F.lit(2.0), F.col("at") / float(90 * DAY) - 100), C.before("ent", "v")
    return o.select("off", "ent", "v", F.round(F.coalesce(F.sum(own).over(f), F.lit(0.0)) / own, 5).alias("n"), F.count("*").over(f).alias("raw"))


@register("supplier_volume", "SELECT l_suppkey AS ent, epoch_us(l_shipdate) // 604800000000 AS week, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1, 2")
def supplier_volume(spark, sf_dir):
    """Weekly shipments by supplier, the input of volume and drift on a third source."""
    x = C.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ent"), F.floor(C.micros(F.col("l_shipdate")) / 604_800_000_000).alias("week"), "l_quantity")
    return x.groupBy("ent", "week").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@register("welford_moments", f"WITH {VERDICTS} SELECT detector, count(*) AS n, round(avg(-ln(p)), 6) AS mean, round(var_samp(-ln(p)), 6) AS variance FROM v GROUP BY 1")
def welford_moments(spark, sf_dir):
    x = -F.log("p")
    return verdicts(spark, sf_dir).groupBy("detector").agg(F.count("*").alias("n"), r6(F.avg(x), "mean"), r6(F.var_samp(x), "variance"))


@register("streaming_counts", "SELECT user_id AS ent, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_counts(spark, sf_dir):
    """The per-entity fold run as a stream over the same file to its end; equal to the batch counts."""
    from ..streaming.replay import replay_counts

    return replay_counts(spark, sf_dir)
