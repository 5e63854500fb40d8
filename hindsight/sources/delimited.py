"""Delimited text to events, with rejected rows set aside; JSON schemas; labels; TSV export."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Schema:
    """Which column is what. ``unit`` is the microseconds of an integer tick; a layout and an epoch may stand for it."""

    source: str
    columns: tuple[str, ...]
    time: str
    entity: str
    unit: int | None = None
    layout: str | None = None
    epoch: str | None = None
    delimiter: str = ","
    missing: str = ""
    admit: str | None = None

    def __post_init__(self):
        if len(self.delimiter.encode()) != 1:
            raise ValueError("the delimiter must be one byte")
        if self.layout is None and not (self.unit and self.unit > 0):
            raise ValueError("a positive unit is needed without a layout")
        if self.layout is not None and not self.epoch:
            raise ValueError("a layout needs an epoch")
        for name in (self.time, self.entity):
            if name not in self.columns:
                raise ValueError(f"no column {name!r}")
        if self.admit is not None:
            re.compile(self.admit)


def load_schema(text: str) -> Schema:
    raw = json.loads(text)
    return Schema(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """offset and line of a text file, plain or gzip. Offsets grow with the place in the file; they are not gapless."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("offset"), F.col("value").alias("line"))


def parse(lines: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """Events (offset, entity, at, fields) and set-aside rows (offset, line, reason).

    The entity filter looks at the raw column and comes first; a row of the wrong length is an error,
    then one with an unreadable time, then one without an entity.
    """
    parts = F.split("line", re.escape(schema.delimiter), -1)
    at = {name: F.get(parts, F.lit(i)) for i, name in enumerate(schema.columns) if name}
    raw, entity = at[schema.time], at[schema.entity]
    if schema.layout is None:
        ticks = raw.try_cast("long")
        time = ticks * F.lit(schema.unit)
    else:
        time = F.unix_micros(F.try_to_timestamp(raw, F.lit(schema.layout))) - F.unix_micros(F.lit(schema.epoch).cast("timestamp"))
    reason = F.when(F.size(parts) != len(schema.columns), "columns")
    if schema.admit is not None:
        reason = reason.when(~entity.rlike(schema.admit), "filtered")
    reason = reason.when(time.isNull(), "time").when((entity == "") | (entity == schema.missing), "entity")
    fields = F.map_from_entries(
        F.filter(
            F.array(*(F.struct(F.lit(n).alias("k"), F.struct(c.alias("text"), (c != schema.missing).alias("usable")).alias("v")) for n, c in at.items() if n not in (schema.time, schema.entity))),
            lambda x: x["v"]["text"] != "",
        )
    )
    rows = lines.withColumn("reason", reason)
    good = rows.where("reason is null").select("offset", entity.alias("entity"), time.alias("at"), fields.alias("fields"))
    return good, rows.where("reason is not null").select("offset", "line", "reason")


def cap(events: DataFrame, max_rows: int | None = None, max_at: int | None = None) -> DataFrame:
    """The first rows by offset, and those before a time."""
    if max_rows is not None:
        events = events.orderBy("offset").limit(max_rows)
    return events if max_at is None else events.where(F.col("at") < max_at)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """time, user, source and destination of a headed CSV, each key once."""
    return spark.read.csv(path, header=True).toDF("time", "user", "src", "dst").dropDuplicates()


def load_partition(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of nodes, degree sums of blocks and weights of pairs of blocks, from JSON whose pair keys are joined by 0x1f."""
    raw = json.loads(text)
    blocks = [(*k.split("\x1f"), int(v)) for k, v in raw["blocks"].items()]
    sums = [(int(k), float(v)) for k, v in raw["degree_sums"].items()]
    pairs = [(*map(int, k.split("\x1f")), float(v)) for k, v in raw["block_weights"].items()]
    return spark.createDataFrame(blocks, "field string, value string, block int"), spark.createDataFrame(sums, "block int, degree double"), spark.createDataFrame(pairs, "a int, b int, weight double")


def export_edges(edges: DataFrame, path: str, least: float = 1e-12) -> None:
    """field_a, value_a, field_b, value_b, weight as sorted TSV."""
    edges.where(F.col("weight") > least).orderBy("field_a", "value_a", "field_b", "value_b").write.csv(path, sep="\t", header=True)


def finite_json(value, path: str = "$") -> str:
    """JSON of a result; a number that is not finite is an error that names its path."""
    import math

    def check(v, at):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"{at} is not finite")
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list | tuple) else ():
            check(x, f"{at}.{k}")

    check(value, path)
    return json.dumps(value, indent=2)
