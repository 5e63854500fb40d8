"""A reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Row numbers come from hashed buckets of a bounded mean size: a row's number is its rank in
its bucket plus the rows of the buckets before. A bucket's rows are ordered by what they
hold, so the numbering depends on the data alone, not on how Spark has dealt them out.

The permutation acts on pairs (x, y) with x < a, y < b, a * b the least such product that
covers the rows: each round adds a keyed hash of one half to the other, modulo a or b. A result
beyond the rows is sent through again (cycle walking) until it falls inside. The shard is the
permuted number modulo the number of shards, the slot is the quotient; both can be computed
for any row number without the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_as

ROUNDS = 8
BUCKET_ROWS = 4096
MAX_BUCKETS = 65_536


def halves(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def walks(n: int) -> int:
    """Passes after which every row number is inside.

    A walk leaves the rows at most a * b - n times. For larger tables 40 passes do: fewer than
    one pass in sqrt(n) lands outside, so a longer walk has a chance below n ** -20; ``permuted``
    raises an error then, rather than return a wrong number.
    """
    a, b = halves(n)
    return min(a * b - n + 1, 40)


def permuted(number: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The place of ``number`` (0 to n - 1) in the shuffle, as a built-in expression."""
    a, b = halves(n)

    def one_round(s: Column, k: Column) -> Column:
        even = (s["x"] + F.pmod(F.xxhash64(s["y"], k, F.lit(seed)), F.lit(a))) % a
        odd = (s["y"] + F.pmod(F.xxhash64(s["x"], k, F.lit(seed)), F.lit(b))) % b
        return F.when(k % 2 == 0, F.struct(even.alias("x"), s["y"].alias("y"))).otherwise(F.struct(s["x"].alias("x"), odd.alias("y")))

    keys = F.array(*(F.lit(k) for k in range(rounds)))

    def once(p: Column) -> Column:
        start = F.struct((p % a).cast("long").alias("x"), F.floor(p / a).cast("long").alias("y"))
        return F.aggregate(keys, start, one_round, lambda s: s["y"] * F.lit(a).cast("long") + s["x"])

    through = F.aggregate(F.sequence(F.lit(1), F.lit(walks(n))), once(number), lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return F.when(through < n, through).otherwise(F.raise_error(F.lit("a walk was too long; take another seed")).cast("long"))


def numbered(rows: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with a column ``row_number`` from 0, and how many there are.

    ``order`` names the columns that place a row; rows equal in all of them are
    interchangeable. Two passes: one counts the buckets, one ranks within them. There is about
    one bucket for ``bucket_rows`` rows but never more than ``MAX_BUCKETS``, so the counts that
    the driver sees and broadcasts take at most a megabyte at any size of the input.
    """
    n = rows.count()
    buckets = min(max(1, -(-n // bucket_rows)), MAX_BUCKETS)
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).collect()
    total, before = 0, []
    for bucket, k in sorted((r["_bucket"], r["_n"]) for r in counts):
        before.append((bucket, total))
        total += k
    offsets = rows.sparkSession.createDataFrame(before, "_bucket long, _before long")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    joined = ranked.join(F.broadcast(offsets), "_bucket")
    return joined.withColumn("row_number", F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_rank", "_before"), n


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and slot under the law ``rows``: counts are at most one apart, slots gapless from 0.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot,
    grown_shard (null under this law) and row_number. Null texts count as empty, null ids are one
    more id, repeated rows each get a place, an empty table gives no rows. Columns other than the
    two named are not read.
    """
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (F.octet_length(empty_as(text)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(empty_as(text), "UTF-8")).alias("text_crc32"),
    )
    found, n = numbered(rows, ["doc_id", "size", "text_crc32"])
    place = found.withColumn("place", permuted(F.col("row_number"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
