"""Ledgers: each arm's ranked daily queues of burn-in and scoring, as Parquet in folders by phase and arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = "d long, rank int, off long, ent long, at long, p double"


def queues(scored: DataFrame, budget: int, burn_in: int) -> DataFrame:
    """phase, arm, d, rank, off, ent, at and p: the first ``budget`` of each arm and day of ``scored`` (arm, d, off, ent, at, p).

    Order: ln p to nine digits, so that the deepest tails stay apart, then time, entity and place, which is total.
    """
    order = Window.partitionBy("arm", "d").orderBy(F.round(F.log("p"), 9), "at", "ent", "off")
    x = scored.where(F.col("p").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)
    return x.select(F.when(F.col("at") < burn_in, "burn_in").otherwise("scoring").alias("phase"), "arm", "d", "rank", "off", "ent", "at", "p")


def write(ranked: DataFrame, path: str) -> None:
    """A ledger of ``queues``; a folder that holds one already is an error."""
    ranked.repartition("phase", "arm").sortWithinPartitions("phase", "arm", "d", "rank").write.partitionBy("phase", "arm").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A ledger; filters on phase and arm choose folders, filters on d skip parts of files."""
    return spark.read.schema(f"{COLUMNS}, phase string, arm string").parquet(path)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """phase, arm, only_a, only_b and moved: alerts of each queue that the other ledger lacks, and those at another rank."""
    key = ["phase", "arm", "d", "off"]
    x = a.select(*key, F.col("rank").alias("a")).join(b.select(*key, F.col("rank").alias("b")), key, "full")
    return x.groupBy("phase", "arm").agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
