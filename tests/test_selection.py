"""Places of a column against sorting it; one value for most rows; ties in numbering."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import evaluate
from quillstack.operators.numbering import numbered
from quillstack.operators.selection import values_at

R = random.Random(7)
COLUMNS = {
    "spread": [R.random() * 10 ** R.randint(-30, 30) * R.choice([1, -1]) for _ in range(3000)], "constant": [2.5] * 3000, "third": [1.0] * 1000 + [R.random() for _ in range(2000)], "few": [float(R.randint(0, 3)) for _ in range(500)],
    "nulls": [None, 3.0, None, 1.0], "infinite": [float("inf"), float("-inf"), 0.0, -0.0, 1.0], "none": [None], "steps": [float(2**i) for i in range(-200, 200)] * 5,
}


@pytest.mark.parametrize("name", COLUMNS)
def test_values_at(spark, name):
    df = spark.createDataFrame([(x,) for x in COLUMNS[name]], "v double").repartition(5)
    ordered = sorted(x for x in COLUMNS[name] if x is not None)
    n = len(ordered)
    places = sorted({1, 2, n // 3 + 1, n // 2, n, n + 1} - {0})
    want = {p: ordered[p - 1] if p <= n else None for p in places}
    assert values_at(df, "v", places, splits=8, held=20) == want
    assert values_at(df, "v", places) == want


def test_latency(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 41)], "seconds double")
    assert tuple(evaluate.latency(df).first()) == (20.5, 38.0)
    assert tuple(evaluate.latency(df.filter("seconds < 2")).first()) == (1.0, 1.0)
    assert tuple(evaluate.latency(df.limit(0)).first()) == (None, None)


def test_numbered_spreads_ties(spark):
    """Equal values of different rows lie in several ranges; places stay a numbering."""
    df = spark.range(4000).select(F.lit(1).alias("v"), "id")
    got = numbered(df, ["v"]).toPandas()
    assert sorted(got["place"]) == list(range(1, 4001))
    two = numbered(spark.range(3000).select((F.col("id") % 2).alias("v"), "id"), ["v"]).toPandas()
    assert (two.sort_values("place")["v"].diff().dropna() >= 0).all()
