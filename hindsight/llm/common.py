"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "6m"
#: Share of the driver's largest heap past which garbage is collected between jobs.
HEAP_SHARE = 0.45
#: Percent of the driver's heap that may be free after a collection, at least and at most; Java's own limits, 40 and 70, keep three times what is in use.
HEAP_FREE = {"MinHeapFreeRatio": 10, "MaxHeapFreeRatio": 25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names; one is made only where
    that setting is missing and the master is local, as in a plain test.
    """
    _shared_folder(df.sparkSession)
    out = df.checkpoint()
    _give_back_heap(df.sparkSession)
    return out


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine without the setting, a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files and checkpoints of frames that nothing refers to any more.

    Its cleaner acts when the driver collects garbage, which a loop of small jobs may not cause for long.
    """
    _collect(df.sparkSession)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):  # not every JVM has these options, which may be set while it runs
        options = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        for name, percent in HEAP_FREE.items():
            options.setVMOption(name, str(percent))
    jvm.System.gc()
    with contextlib.suppress(Exception):
        _trim_native(spark)


def _trim_native(spark: SparkSession) -> str:
    """``jcmd System.trim_native_heap`` on the driver: what its compiler and collector have freed goes back to the system."""
    new, jvm = spark.sparkContext._gateway.new_array, spark.sparkContext._jvm
    java = jvm.java.lang

    def array(kind, *items):
        out = new(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    of = java.Class.forName
    # by reflection, as the server's own class is not open to callers
    types = array(java.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
    invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", types)
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    return invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, commands, "systemTrimNativeHeap", array(java.Object), array(java.String)))


def _give_back_heap(spark: SparkSession) -> None:
    """Have the driver's garbage collected once its heap has grown past ``HEAP_SHARE`` of what it may take.

    A query of many small jobs leaves so much behind, mostly plans, that the heap grows to its limit
    though a fraction of it is in use; collecting it within ``HEAP_FREE`` gives the rest back to the system.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        _collect(spark)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """``mapInArrow`` over column batches.

    ``make`` runs once in each task and returns a function from a batch to dictionaries
    of columns; a final call with ``None`` lets it flush what it still holds. The session's
    batches are lowered to ``BATCH_BYTES``, as texts stand in memory several times on the way.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES, "64m") != BATCH_BYTES:
        conf.set(_BYTES, BATCH_BYTES)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        step = make()
        for batch in batches:
            for out in step(batch):
                yield _batch(out, arrow)
        for out in step(None):
            yield _batch(out, arrow)
        del step
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return what a task has freed to the system: its worker lives on, beside others, for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        x = columns[field.name]
        arrays.append(x if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_array(flat: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of ``rows`` rows, so that what is held at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def empty_as(c: Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(c, F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component = smallest node.

    Every node is tied to the one with the most links among itself and its neighbours, and so is
    that one in turn; both are of one component, so the edges are contracted to those between
    nodes that are still apart, until none is left. Each round takes what the contraction leaves,
    nothing is gathered by node, and each round is cut from its lineage. A self-edge is allowed.
    Isolated nodes are not returned.
    """
    labels = contracted(edges, max_rounds)
    least = labels.groupBy("up").agg(F.least(F.min("node"), F.col("up")).alias("component"))
    return labels.join(least, "up").select("node", "component")


def contracted(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``components`` named by any node of theirs: rows (node, up), cut."""
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    for _ in range(max_rounds):
        if labels is not None and e.isEmpty():
            return labels
        step = cut(hooked(e))
        if labels is None:
            labels = step
        else:
            labels = cut(labels.join(step.select(F.col("node").alias("up"), F.col("up").alias("further")), "up", "left").select("node", F.coalesce("further", "up").alias("up")))
        for side in ("a", "b"):
            e = e.join(step.select(F.col("node").alias(side), F.col("up").alias(f"to_{side}")), side)
        e = cut(e.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def hooked(edges: DataFrame) -> DataFrame:
    """(node, up): of each node of the distinct ``edges`` (a, b), a node of its component, two steps up towards more links."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    links = both.groupBy("x").agg(F.count("*").alias("links"))
    around = both.join(links.select(F.col("x").alias("y"), "links"), "y").select("x", F.struct("links", "y").alias("r"))
    around = around.unionAll(links.select("x", F.struct("links", F.col("x").alias("y")).alias("r")))
    above = cut(around.groupBy("x").agg(F.max("r").alias("r")).select("x", F.col("r.y").alias("y")))
    return above.join(above.select(F.col("x").alias("y"), F.col("y").alias("up")), "y").select(F.col("x").alias("node"), "up")


def sized(df: DataFrame, most: int) -> DataFrame:
    """A cut frame, marked for broadcast if it has at most ``most`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Smaller on disk than a checkpoint, and later reads take only the columns they need. The
    folder is deleted when the application ends in an orderly way.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _give_back_heap(spark)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
