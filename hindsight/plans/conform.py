"""The event model: source, entity, time in microseconds, order within a time, and named fields.

Order is total: (at, off). Every statistic of an event is taken from what stands strictly before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
HALF_LIFE = 7 * DAY
#: Origin of decayed sums; weights are 2 ** ((at - ORIGIN) / half-life).
ORIGIN = 1_704_067_200_000_000
BURN_IN = ORIGIN + 14 * DAY
#: Observations of a field, over all entities, before its kind is settled and its values are stored.
SETTLE = 50

EVENT_FIELDS = ("event_type", "k", "band")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """off, ent, at, event_type, value, k and the value's band, of the events table."""
    from ..functions.scalar import band

    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("off"), F.col("user_id").alias("ent"), micros(F.col("ts")).alias("at"), "event_type", "value", F.get_json_object("props", "$.k").alias("k")
    ).withColumn("band", band(F.col("value")))


def settled_after(e: DataFrame, observations: int = SETTLE) -> DataFrame:
    """One row (s_at, s_off): the place of the last event before a field that all events carry is settled.

    A top-k of the order, not a sort of the table.
    """
    first = e.select("at", "off").orderBy("at", "off").limit(observations)
    return first.agg(F.max(F.struct("at", "off")).alias("s"), F.count("*").alias("n")).where(F.col("n") >= observations).select(F.col("s.at").alias("s_at"), F.col("s.off").alias("s_off"))


def settled(e: DataFrame, observations: int = SETTLE) -> DataFrame:
    """``e`` with ``known``: whether fields are settled when the event is scored. The joined row is a single one."""
    at = F.broadcast(settled_after(e, observations))
    return e.join(at, F.lit(True), "left").withColumn("known", F.coalesce(F.struct("at", "off") > F.struct("s_at", "s_off"), F.lit(False))).drop("s_at", "s_off")


def before(*keys: str):
    """The frame of all earlier rows of the same keys."""
    return Window.partitionBy(*keys).orderBy("at", "off").rowsBetween(Window.unboundedPreceding, -1)


def by_entity(e: DataFrame) -> DataFrame:
    """``e`` with all rows of an entity in one task, in order: windows and groups of an entity's rows need no further shuffle.

    What they sum is then computed behind the shuffle, not carried through it.
    """
    return e.repartition("ent").sortWithinPartitions("ent", "at", "off")


def day(at: str = "at") -> Column:
    return F.floor(F.col(at) / DAY).cast("long")


def weight(at: Column, half_life: int = HALF_LIFE) -> Column:
    """2 ** ((at - ORIGIN) / half-life): a decayed sum is a plain sum of these, divided by the reader's own."""
    return F.pow(F.lit(2.0), (at - F.lit(ORIGIN)) / F.lit(float(half_life)))


def running(df: DataFrame, keys: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """Exclusive prefix sums over (at, off) within ``keys``, in two levels.

    Sums by time bucket, a scan over the few buckets of a key, and a scan within each bucket: a key
    with a third of all rows is spread over its buckets. ``values`` maps new columns to what is summed.
    """
    bucket = day() if bucket is None else bucket
    rows = df.withColumn("_b", bucket)
    for name, value in values.items():
        rows = rows.withColumn(f"_{name}", value)
    parts = rows.groupBy(*keys, "_b").agg(*(F.sum(f"_{n}").alias(f"_p_{n}") for n in values))
    scan = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_b", *(F.coalesce(F.sum(f"_p_{n}").over(scan), F.lit(0)).alias(f"_s_{n}") for n in values))
    own = Window.partitionBy(*keys, "_b").orderBy("at", "off").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(parts, [*keys, "_b"])
    for n in values:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.coalesce(F.sum(f"_{n}").over(own), F.lit(0)))
    return out.drop("_b", *(f"_{n}" for n in values), *(f"_s_{n}" for n in values))
