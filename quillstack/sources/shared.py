"""The cluster's shared folder, and cutting lineage through it."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that spread() makes, about.
SPREAD = 1 << 18

_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def place(spark: SparkSession, name: str = "part") -> str:
    """A new path in the shared folder, which sweep() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """For writes: what they shuffle is deleted as they end, else it stays on disk until the driver's collector finds it."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    What was written stays until discard() or sweep(), since whoever holds a DataFrame over it may read it again.
    """
    path = place(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spread(rows: DataFrame, *keys: str, most: int = SPREAD) -> DataFrame:
    """rows dealt by keys over partitions of about `most` rows, or one for each core where rows are few. Adaptive execution joins partitions by
    their compressed bytes, so that a task's rows, and the memory to sort them, would grow with the table."""
    return rows.repartition(max(rows.count() // most + 1, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def discard(*parts: DataFrame) -> None:
    """Delete what cut() wrote for these DataFrames, once nothing reads it any more: the rounds behind an iteration."""
    for df in parts:
        _delete(df.sparkSession, df.written_to)


def sweep(spark: SparkSession) -> None:
    """Delete all that cut() wrote in this application; DataFrames over it can't be read afterwards."""
    for path in list(_written.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a folder's parts epoch=N, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _delete(spark: SparkSession, path: str) -> None:
    remove(spark, path)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)
