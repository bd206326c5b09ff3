"""Tables laid out by buckets of a key: a change reads and overwrites the buckets of its own keys, nothing else.

Every rule of operators.library that decides key by key holds within a bucket, so a change is such a rule applied to the touched buckets' old
rows and the delta. Their new rows are written beside first and then put in place by partition; a change that is cut off and run again gives
the same table, since rules replace or ignore what is there already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quillstack.operators import graph, library
from quillstack.sources.shared import cut, discard, remove

BUCKETS = 64


class BucketTable:
    """A table in a folder, bucket=B/, by hash of one key column. Rows of a null key are bucket 0."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType([f for f in schema.fields if f.name != "bucket"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketTable:
        out = cls(rows.sparkSession, path, key, rows.schema, buckets)
        out._write(rows)
        return out

    def bucket(self, key: Column | str) -> Column:
        c = F.col(key) if isinstance(key, str) else key
        return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c.cast(self.schema[self.key].dataType)), F.lit(self.buckets))).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields]).add("bucket", IntegerType())).parquet(self.path)

    def read(self, keys: Iterable | None = None) -> DataFrame:
        """The table, or the rows of the listed keys, from their buckets alone."""
        if keys is None:
            return self._stored().drop("bucket")
        wanted = list(dict.fromkeys(keys))
        at = self.spark.createDataFrame([(k,) for k in wanted], StructType([self.schema[self.key]]))
        return self._of(at).filter(F.col(self.key).isin(wanted))

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of a table's keys: as many as there are buckets, at most."""
        return sorted(r[0] for r in keys.select(self.bucket(self.key)).distinct().collect())

    def _of(self, keys: DataFrame) -> DataFrame:
        return self._in(self._touched(keys))

    def _in(self, touched: list[int]) -> DataFrame:
        return self._stored().filter(F.col("bucket").isin(touched)).drop("bucket")

    def _write(self, rows: DataFrame) -> None:
        # Rows of a bucket stay together; one that is very large is split over tasks.
        rows.select(*self.schema.names, self.bucket(self.key).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def change(self, delta: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put rule(old rows, delta) in place of the old rows in the delta's buckets; returns these. delta has the key."""
        delta = cut(delta, "delta")
        touched = self._touched(delta)
        new = cut(rule(self._in(touched), delta).select(*self.schema.names), "buckets")
        self._write(new)
        for b in sorted(set(touched) - {r[0] for r in new.select(self.bucket(self.key)).distinct().collect()}):
            remove(self.spark, f"{self.path}/bucket={b}")  # nothing is left in it
        discard(delta, new)
        return touched

    # ---- the library's changes

    def insert_or_ignore(self, fresh: DataFrame, keys: list[str], order: list[str]) -> list[int]:
        """Rows of keys not there yet, the first of equal ones. keys hold the table's key."""
        return self.change(fresh, lambda old, new: library.insert_or_ignore(old, new, keys, order))

    def insert_or_replace(self, fresh: DataFrame, keys: list[str], order: str) -> list[int]:
        """Rows in place of those of their keys, the last of equal ones."""
        return self.change(fresh, lambda old, new: library.insert_or_replace(old, new, keys, order))

    def replace(self, fresh: DataFrame) -> list[int]:
        """All rows of a key for all fresh rows of it: a paper's chunks."""
        return self.change(fresh, lambda old, new: library.replace_rows(old, new, self.key))

    def replace_citations(self, fresh: DataFrame) -> list[int]:
        return self.change(fresh, graph.replace_citations)

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(keys.select(self.key), lambda old, gone: old.join(gone, self.key, "left_anti"))

    def update_points(self, delta: DataFrame) -> list[int]:
        """Values of delta(id, ...) that are not null, in a table by id."""
        return self.change(delta, library.update_points)

    def upsert_index(self, delta: DataFrame) -> list[int]:
        """Vectors of delta(id, embedding) put in, those of null vectors taken out, in a table by id."""
        return self.change(delta, library.upsert_index)
