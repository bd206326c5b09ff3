"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.sources.shared import cut, discard


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (node, component), component being the smallest node.

    Alternating star contraction: every round rewires each node's larger, then smaller, neighbours to the
    smallest node around it, so path lengths shrink geometrically. Neighbour minima are partial aggregates;
    the joins back are plain equi-joins that adaptive execution can split when one node is a hub. Each round
    is written to the shared folder, and the rounds behind it are deleted. Null ends and self-loops are ignored; nodes without edges do not appear.
    """
    tidy = lambda df: df.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    edges = cut(tidy(edges), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(tidy(large), "edges")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(tidy(small), "edges")
        discard(last, large)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
