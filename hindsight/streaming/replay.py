"""The stream form of the per-entity arms: the same events, folded with state by key."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.conform import HALF_LIFE, micros


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events.parquet}}")
    return s.select(F.col("event_id").alias("off"), F.col("user_id").alias("ent"), micros(F.col("ts")).alias("at"), "event_type")


def decayed_novelty(stream: DataFrame, half_life: int = HALF_LIFE, alpha: float = 1.0) -> DataFrame:
    """off, n_v, n, k of each event against its entity's state, which is then advanced: score first, commit after.

    State is the decayed count and the last time of each value of an entity. An event older than
    the last one of its value decays nothing and does not set time back.
    """

    def fold(key, frames, state):
        kept = dict(zip(*state.get, strict=True)) if state.exists else {}
        kept = {v: tuple(map(float, x.split(" "))) for v, x in kept.items()}
        for f in frames:
            rows = []
            for at, off, v in f.sort_values(["at", "off"])[["at", "off", "event_type"]].itertuples(index=False):
                now = {u: c * 2 ** (-max(0.0, at - t) / half_life) for u, (c, t) in kept.items()}
                rows.append((off, now.get(v, 0.0), sum(now.values()), len(now)))
                kept[v] = (now.get(v, 0.0) + 1, max(float(at), kept.get(v, (0, 0.0))[1]))
            yield pd.DataFrame(rows, columns=["off", "n_v", "n", "k"])
        state.update((list(kept), [f"{c!r} {t!r}" for c, t in kept.values()]))

    return stream.groupBy("ent").applyInPandasWithState(fold, "off long, n_v double, n double, k long", "names array<string>, cells array<string>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives, once what is there has been read: written as Parquet to the shared folder, never to the driver."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="streams-")
    path = f"{top}/stream-{uuid.uuid4().hex}"
    write = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(source(spark, sf_dir).groupBy("ent", "event_type").agg(F.count("*").alias("n")), "complete")
