"""Retrieval evaluation: expected titles, passes, ranks, recall@k, MRR, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import values_at


def resolve_titles(expected: DataFrame, papers: DataFrame) -> DataFrame:
    """(case_id, pattern, paper_id, matches): papers whose title contains the pattern, regardless of case; a sound
    case has one match for each pattern. Cases are few and fixed, papers are scanned once."""
    hit = expected.join(papers.select(F.col("id").alias("paper_id"), F.lower("title").alias("t")), F.contains("t", F.lower("pattern")))
    return hit.groupBy("case_id", "pattern").agg(F.min("paper_id").alias("paper_id"), F.count("*").alias("matches"))


def judge(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, passed, best_rank, rr) from ranked(case_id, paper_id, rank) and expected(case_id, paper_id, need_all)."""
    r = ranked.filter(F.col("rank") <= k).select("case_id", "paper_id", "rank")
    e = expected.join(r, ["case_id", "paper_id"], "left")
    g = e.groupBy("case_id").agg(F.bool_and(F.col("rank").isNotNull()).alias("all_"), F.bool_or(F.col("rank").isNotNull()).alias("any_"), F.bool_or("need_all").alias("need"), F.min("rank").alias("best_rank"))
    return g.select("case_id", F.when(F.col("need"), F.col("all_")).otherwise(F.col("any_")).alias("passed"), "best_rank", F.round(F.coalesce(1 / F.col("best_rank"), F.lit(0.0)), 6).alias("rr"))


def summary(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


def latency(times: DataFrame, col: str = "seconds") -> DataFrame:
    """Median and the value at place max(0, int(0.95 n) - 1) of the sorted times; null without times."""
    n = times.filter(F.col(col).isNotNull()).count()
    low, high, late = (n + 1) // 2, n // 2 + 1, max(1, int(0.95 * n))
    at = values_at(times, col, [low, high, late]) if n else {}
    half = None if not n else (at[low] + at[high]) / 2
    one = times.sparkSession.createDataFrame([(half, at.get(late))], "median double, p95 double")
    return one.select(F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


def gate(recall: float, least: float = 0.9) -> bool:
    return recall >= least


def gated(summary: DataFrame, least: float = 0.9) -> DataFrame:
    """A summary with `passed`, whether its recall reaches the gate."""
    return summary.withColumn("passed", F.col("recall") >= least)
