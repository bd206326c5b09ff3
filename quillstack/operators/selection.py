"""Exact values at given places of a sorted column, without sorting it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splitting values of a pass; values that are looked up one by one.
SPLITS, HELD = 64, 4096


def values_at(rows: DataFrame, value: Column | str, places: Sequence[int], splits: int = SPLITS, held: int = HELD) -> dict[int, float | None]:
    """{place: value} for places from 1 in ascending order; None beyond the last. Nulls do not count.

    A pass takes approximate quantiles of what is left as splitting values and counts exactly how many values lie below and at each. A
    place within the values equal to one of them is found; else the values between two neighbours are left, about a `splits`th.
    Passes read one column and send back a row; a value that a third of all rows share is found in the first pass.
    """
    v = rows.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).filter("v is not null")
    out: dict[int, float | None] = {}
    for place in dict.fromkeys(places):
        out[place] = _value_at(v, place, splits, held)
    return out


def _value_at(v: DataFrame, place: int, splits: int, held: int) -> float | None:
    below, low, high = 0, None, None
    while True:
        part = v if low is None else v.filter(F.col("v") > low)
        part = part if high is None else part.filter(F.col("v") < high)
        sizes = part.agg(F.count("*").alias("n"), F.percentile_approx("v", [i / splits for i in range(splits + 1)], 100 * splits).alias("at")).first()
        if not 0 < place - below <= sizes["n"]:
            return None
        if sizes["n"] <= held:
            counts = part.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()  # `held` rows at most
            for r in counts:
                below += r["n"]
                if below >= place:
                    return r["v"]
        at = sorted(set(sizes["at"]))
        seen = part.agg(*[F.count_if(F.col("v") < x).alias(f"l{i}") for i, x in enumerate(at)], *[F.count_if(F.col("v") <= x).alias(f"e{i}") for i, x in enumerate(at)]).first()
        low_, high_, start = low, high, below
        for i, x in enumerate(at):
            if start + seen[f"l{i}"] < place <= start + seen[f"e{i}"]:
                return x
            if start + seen[f"e{i}"] < place:
                below, low_ = start + seen[f"e{i}"], x
            else:
                high_ = x
                break
        low, high = low_, high_
