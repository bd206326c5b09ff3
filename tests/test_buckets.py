"""Tables by bucket: a change leaves other buckets' files as they are, and equals the change of a whole table."""

import os

from pyspark.sql import functions as F

from quillstack.operators import library
from quillstack.sources.buckets import BucketTable


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(spark, tmp_path, n=500, buckets=16):
    df = spark.range(n).select("id", (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("s"))
    return df, BucketTable.create(df, str(tmp_path / "t"), "id", buckets)


def test_only_touched_buckets_change(spark, tmp_path):
    df, t = made(spark, tmp_path)
    before = files(t.path)
    delta = spark.createDataFrame([(3, 100, "a"), (3, 200, "b"), (9000, 1, "c")], "id long, v long, s string")
    touched = t.insert_or_replace(delta, ["id"], "v")
    after = files(t.path)
    same = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 2 and len({f.split("/")[0] for f in same}) >= 14 and all(after.get(f) == before[f] for f in same)
    assert rows(t.read()) == rows(library.insert_or_replace(df, delta, ["id"], "v"))
    t.insert_or_replace(delta, ["id"], "v")
    assert rows(t.read()) == rows(library.insert_or_replace(df, delta, ["id"], "v"))
    assert rows(t.read([3, 4, 3])) == [(3, 200, "b"), (4, 4, None)]
    plan = t.read([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")


def test_rules(spark, tmp_path):
    df, t = made(spark, tmp_path)
    fresh = spark.createDataFrame([(5, 50, "x"), (600, 1, "y"), (600, 2, "z")], "id long, v long, s string")
    t.insert_or_ignore(fresh, ["id"], ["v"])
    want = library.insert_or_ignore(df, fresh, ["id"], ["v"])
    assert rows(t.read()) == rows(want)
    t.delete(spark.createDataFrame([(i,) for i in range(0, 700, 3)], "id long"))
    assert rows(t.read()) == rows(want.filter("id % 3 <> 0"))
    t.update_points(spark.createDataFrame([(7, 70), (8, None), (9999, 1)], "id long, v long"))
    assert rows(t.read([7, 8, 9999])) == [(7, 70, None), (8, 1, None)]


def test_emptied_and_null(spark, tmp_path):
    """A bucket that loses all its rows is empty; rows without a key stay; a change of nothing changes nothing."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, s string")
    t = BucketTable.create(df, str(tmp_path / "t"), "id", 64)
    t.delete(spark.createDataFrame([(1,), (2,)], "id long"))
    assert rows(t.read()) == [(None, "n")]
    assert t.delete(spark.createDataFrame([], "id long")) == [] and rows(t.read()) == [(None, "n")]
    t.replace(spark.createDataFrame([(1, "again"), (1, "and again")], "id long, s string"))
    assert rows(t.read()) == [(1, "again"), (1, "and again"), (None, "n")]
