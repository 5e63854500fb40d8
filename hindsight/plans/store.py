"""Frames written to the folder that all executors share, so that a lost executor costs no more than one step."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a new one only where that is unset and the master is this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written there; its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_KEPT: dict[tuple, str] = {}


def stored(df: DataFrame, name: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written there as Parquet, in folders ``by`` and files sorted by ``order``, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows = df.repartition(*by).sortWithinPartitions(*by, *order) if by else df
    rows.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """What ``make`` gives, written once in a session for a source whose files have not changed since, and read from there by all who ask.

    A file counts as changed by its path, length and time. Where the folder is gone, it is made again. Each task writes what it has of
    each of the folders ``by``, in ``order``: a few folders would be as many tasks, if the rows were dealt by them.
    """
    key = _key(spark, name, source)
    if not _is_kept(spark, key):
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df = make()
        (df.sortWithinPartitions(*by, *order) if by else df).write.partitionBy(*by).parquet(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def found(spark: SparkSession, name: str, source: str) -> DataFrame | None:
    """What ``kept`` has written in this session for the source as it is now; None if nothing."""
    key = _key(spark, name, source)
    return spark.read.parquet(_KEPT[key]) if _is_kept(spark, key) else None


def _key(spark: SparkSession, name: str, source: str) -> tuple:
    return (spark.sparkContext.applicationId, name, _state(spark, source))


def _is_kept(spark: SparkSession, key: tuple) -> bool:
    return key in _KEPT and _exists(spark, _KEPT[key])


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(place)


def _state(spark: SparkSession, source: str) -> tuple:
    place, fs = _fs(spark, source)
    files = fs.listStatus(place) if fs.getFileStatus(place).isDirectory() else [fs.getFileStatus(place)]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
