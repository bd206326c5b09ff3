"""Shared pieces of these operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators.components import components
from quillstack.sources.shared import cut, discard, shared_dir

__all__ = ["components", "cut", "discard", "give_back", "mix64", "may_hold", "quoted", "shared_dir", "sieve", "sliding_min", "slices", "small_batches"]

#: Rows that a task looks at together.
ROWS = 256


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most so many rows. What a task took for them goes back to the system at its
    end, since Spark keeps Python workers for other tasks."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        give_back()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """For jobs run inside: Arrow batches of few rows, for rows with long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bits of a sieve: 8 MB, whatever the number of keys.
SIEVE = 1 << 26


def sieve(keys: DataFrame, size: int = SIEVE) -> DataFrame:
    """A bitmap of the keys' (64-bit hashes, the only column) places, in rows (bucket, bits) of 4 kB.

    Rows whose place is not set are none of the keys and need no join with them; an exact join decides on the others.
    The size is fixed, so that it may be broadcast; with very many keys it lets all rows pass to the join.
    """
    at = F.pmod(F.col(keys.columns[0]), F.lit(size))
    return cut(keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "sieve")


def may_hold(rows: DataFrame, key: Column, held: DataFrame, name: str = "maybe", size: int = SIEVE) -> DataFrame:
    """rows with a boolean column: whether a sieve's bit for the key is set."""
    at = F.pmod(key, F.lit(size))
    rows = rows.withColumns({"_bucket": F.bitmap_bucket_number(at), "_at": F.bitmap_bit_position(at)})
    out = rows.join(F.broadcast(held.withColumnsRenamed({"bucket": "_b", "bits": "_bits"})), F.col("_bucket") == F.col("_b"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.call_function("getbit", byte.cast("long"), F.expr("cast(_at % 8 as int)"))
    return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_bucket", "_at", "_b", "_bits")


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling the window."""
    have = 1
    while have < w:
        step = min(have, w - have)
        a = np.minimum(a[: len(a) - step], a[step:])
        have += step
    return a
