"""Running sums and ranks in a total order, without all rows of a key, or of the table, in one task.

Rows are dealt by ranges of the order, so that even one key, or one value many times over, is spread over all tasks.
A row's sum is that of the ranges before its own, of which there are as many as tasks, and that within its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut


def prefix(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: its total over the rows of the same ``keys`` up to this one in ``order``.

    Rows that are equal in all of ``order`` are in any order among themselves.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, value in sums.items():
        df = df.withColumn(f"_{name}", value)
    # ranges are drawn from a sample: what they are must not change between the two readings
    dealt = cut(df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id()))
    parts = dealt.groupBy("_piece", *keys).agg(*(F.sum(f"_{s}").alias(f"_p_{s}") for s in sums))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    parts = parts.select("_piece", *keys, *(F.coalesce(F.sum(f"_p_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums))
    here = Window.partitionBy("_piece", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(f"_{s}").over(here).alias(s) for s in sums)).join(parts, ["_piece", *keys])
    for s in sums:
        out = out.withColumn(s, F.col(s) + F.col(f"_b_{s}"))
    return out.drop("_piece", *(f"_{s}" for s in sums), *(f"_b_{s}" for s in sums))


def numbered(df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's rank from 1 in ``order``, within ``keys`` if any are given."""
    return prefix(df, keys or [], order, {name: F.lit(1).cast("long")})
