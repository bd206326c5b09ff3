"""Containment against all pairs; titles of one beginning do not meet in one group."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators.containment import contained, pieces


def texts(n=150, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(2, 6)))
    long = ["introductionto" + "".join(word() for _ in range(r.randint(1, 8))) for _ in range(n)] + ["".join(word() for _ in range(8)) for _ in range(40)]
    short = []
    for t in long[::2]:
        a = r.randint(0, max(0, len(t) - 14))
        short.append(t[a : a + r.choice([5, 12, 13, 20, 60])])
    return short + ["introductionto", "introduction", "notthereatall", None, "", "long" * 50] + long[:5], long + long[:9] + [None, "é" * 30]


@pytest.mark.parametrize("frequent", [3, 1000])
def test_all_pairs(spark, frequent):
    short, long = texts()
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "t string").repartition(4)
    got = [tuple(r) for r in contained(frame(short), frame(long), frequent=frequent).collect()]
    want = {(s, t) for s in short for t in long if s and t and len(s) >= 12 and s in t}
    assert sorted(got) == sorted(want) and len(want) > 150


def test_one_beginning(spark):
    """Twenty thousand titles that begin alike: what meets on a piece is little more than what is found."""
    df = spark.range(20_000).select(F.concat(F.lit("introductionto"), F.lpad(F.conv(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"), 10, 36), 9, "x"), F.lpad(F.conv("id", 10, 36), 6, "y")).alias("t")).cache()
    assert contained(df, df).count() == 20_000
    held = df.select(F.explode(pieces("t", 12)).alias("p"), "t").groupBy("p").agg(F.count("*").alias("n"))
    rare = df.select("t", F.explode(pieces("t", 12)).alias("p")).join(held, "p").groupBy("t").agg(F.min("n").alias("n"))
    assert rare.agg(F.max("n")).first()[0] <= 2
