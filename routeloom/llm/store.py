"""Intermediate tables in the folder that every executor shares.

Stages that are read more than once are written as Parquet below
``spark.checkpoint.dir``; a lost executor then costs the tasks it ran and never
the lineage before the written table.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = "spark.checkpoint.dir"
#: Tables by the group that was open when they were written: (path, name in the session's catalogue or empty).
_GROUPS: dict[str, list[tuple[str, str]]] = {}
_OPEN: list[str] = []


@contextmanager
def group(name: str):
    """Tables written inside belong to the group, so that :func:`release` can remove them together."""
    _OPEN.append(name)
    try:
        yield
    finally:
        _OPEN.pop()


def release(spark: SparkSession, name: str) -> None:
    """Remove the tables of a group.  Only for groups whose results have been written elsewhere."""
    for path, table in _GROUPS.pop(name, []):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _note(path: str, table: str = "") -> None:
    if _OPEN:
        _GROUPS.setdefault(_OPEN[-1], []).append((path, table))


def shared_dir(spark: SparkSession) -> str:
    """Folder of the session's ``spark.checkpoint.dir``; where that is unset, a private one, for a driver without executors only."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="routeloom-")
        spark.conf.set(_KEY, folder)
        atexit.register(_remove, folder.removeprefix("file://"))
    app = spark.sparkContext.applicationId
    return f"{folder.rstrip('/')}/routeloom/{app}"


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that Spark's file system removes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def tidy(spark: SparkSession) -> None:
    """Let the session find the shuffle files of stages whose results have been written: nothing refers to them any more."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame over the written files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    _note(path)
    return spark.read.schema(_loose(df.schema)).parquet(path)


def materialize_bucketed(df: DataFrame, tag: str, n: int, key: str) -> DataFrame:
    """Write ``df`` clustered into ``n`` buckets of ``key``: later joins on ``key`` do not move its rows.

    Only a catalogue knows buckets, so the files get a name there until the driver ends or their group is released.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    name = f"routeloom_{tag}_{uuid.uuid4().hex[:12]}"
    (
        df.repartition(n, key)
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", path)
        .bucketBy(n, key)
        .saveAsTable(name)
    )
    _note(path, name)
    if not _NAMED:
        atexit.register(_forget, spark)
    _NAMED.append(name)
    return spark.table(name)


_NAMED: list[str] = []


def _forget(spark: SparkSession) -> None:
    """Drop the names of bucketed tables from the catalogue; a stopped session has lost them already."""
    import contextlib

    for name in _NAMED:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _loose(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Up to so many row numbers (8 bytes each) go to every executor to drop their rows in place; beyond that the rows are joined.
_BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped`` (one column); the rows move only if many go."""
    dropped = materialize(dropped, "dropped")
    few = dropped.count() <= _BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti")
