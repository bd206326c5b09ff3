"""The search plan for a table of queries: all cases and their variants in one plan, over stored indexes.

Queries are rows (case, v, text, vector): v numbers a case's variants, vector may be null. Lists, fusion, filters, pools and fallbacks go by
(case, id) with ranks within a case, so the number of queries changes neither the plan nor the number of jobs. A search of one query
is a table of one row. filters(case, filter) names the filter of a case, none for a case that allows all papers, and allowed(filter, id) has the
papers that pass each filter, once each: as many rows as the filters pass, however many cases share them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.operators import search as S
from quillstack.operators.gram_index import GramIndex
from quillstack.operators.vector_index import VectorIndex
from quillstack.plans.search import with_index_text
from quillstack.sources.shared import cut

ONE = ["case", "v"]


@dataclass
class SearchIndex:
    """What a search reads: grams of papers' index texts and of chunks, vectors of both (None without an embedder), and which chunk is
    whose (chunk ids and paper ids alone)."""

    papers: GramIndex
    chunks: GramIndex
    paper_vectors: VectorIndex | None
    chunk_vectors: VectorIndex | None
    owners: DataFrame

    @classmethod
    def build(cls, path: str, papers: DataFrame, chunks: DataFrame, paper_vectors: DataFrame | None = None, chunk_vectors: DataFrame | None = None) -> SearchIndex:
        """papers with the columns of index_text(), chunks(id, paper_id, text), vectors(id, embedding)."""
        spark, path = papers.sparkSession, path.rstrip("/")
        GramIndex.build(with_index_text(papers).select("id", F.col("index_text").alias("text")), f"{path}/papers")
        GramIndex.build(chunks.select("id", "text"), f"{path}/chunks")
        chunks.select("id", "paper_id").write.mode("overwrite").parquet(f"{path}/owners")
        for name, vectors in (("paper_vectors", paper_vectors), ("chunk_vectors", chunk_vectors)):
            if vectors is not None:
                VectorIndex.build(vectors, f"{path}/{name}")
        return cls.open(spark, path, paper_vectors is not None, chunk_vectors is not None)

    @classmethod
    def open(cls, spark: SparkSession, path: str, paper_vectors: bool = True, chunk_vectors: bool = True) -> SearchIndex:
        vectors = [VectorIndex(spark, f"{path}/{name}") if there else None for name, there in (("paper_vectors", paper_vectors), ("chunk_vectors", chunk_vectors))]
        return cls(GramIndex(spark, f"{path}/papers"), GramIndex(spark, f"{path}/chunks"), *vectors, spark.read.parquet(f"{path}/owners"))


def fused(lists: list[DataFrame]) -> DataFrame:
    """(case, id, score): reciprocal ranks summed over a case's lists (case, v, id, rank)."""
    every = lists[0].select("case", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("case", "id", "rank"))
    # In one order, so that the sum is the same each time; a case has few lists.
    shares = F.array_sort(F.collect_list(1 / (F.lit(S.RRF_K) + F.col("rank"))))
    return every.groupBy("case", "id").agg(F.round(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), S.DIGITS).alias("score"))


def best(rows: DataFrame, most: int, *order, within: str = "case", name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(within).orderBy(*order))).filter(F.col(name) <= most)


def passed(rows: DataFrame, filters: DataFrame | None, allowed: DataFrame | None, key: str = "id") -> DataFrame:
    """rows(case, key, ...) of papers that pass their case's filter."""
    if filters is None or allowed is None:
        return rows
    ok = allowed.select("filter", F.col("id").alias(key), F.lit(True).alias("_ok"))
    return rows.join(filters.select("case", "filter"), "case", "left").join(ok, ["filter", key], "left").filter("filter is null or _ok").select(*rows.columns)


def candidates(index: SearchIndex, queries: DataFrame, filters: DataFrame | None = None, allowed: DataFrame | None = None, pool: int = S.POOL) -> DataFrame:
    """(case, id, score): each case's best papers. Filters apply after the lists are cut, as in a search of one query."""
    lists = [index.papers.topk(queries, ONE, S.FETCH, whole=True)]
    if index.paper_vectors:
        lists.append(index.paper_vectors.topk(queries, ONE, S.FETCH))
    return best(passed(fused(lists), filters, allowed), pool, F.desc("score"), "id").select("case", "id", "score")


def chunk_hits(index: SearchIndex, queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """(case, paper_id, id, score): chunks of each case's chosen papers (case, id), fused over its variants."""
    inside = cut(chosen.select("case", F.col("id").alias("paper_id")).join(index.owners, "paper_id"), "inside")
    # A case's chunks, once for each of its variants.
    allowed = queries.select(*ONE).join(inside.select("case", "id"), "case")
    lists = [index.chunks.topk(queries, ONE, S.FETCH, allowed=allowed)]
    if index.chunk_vectors:
        lists.append(_nearest_of(index.chunk_vectors, queries, allowed))
    return fused(lists).join(inside, ["case", "id"]).select("case", "paper_id", "id", "score")


def _nearest_of(index: VectorIndex, queries: DataFrame, allowed: DataFrame, k: int = S.FETCH) -> DataFrame:
    """(case, v, id, sim, rank): the k nearest of the rows that each query allows: as many products as there are such rows."""
    rows = index.rows().select("id", F.col("v").alias("x")).join(allowed, "id")
    q = queries.filter("vector is not null").select(*ONE, F.col("vector").cast("array<double>").alias("y"))
    length = lambda c: F.aggregate(c, F.lit(0.0), lambda a, t: a + t * t)
    pairs = rows.join(q, ONE).filter(F.size("x") == F.size("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, t: a + t)
    norm = lambda c: F.when(length(c) == 0, 1.0).otherwise(F.sqrt(length(c)))
    near = pairs.select(*ONE, "id", F.round(dot / (norm("x") * norm("y")), 6).alias("sim"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*ONE).orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)


def by_paper(hits: DataFrame, keep: int) -> DataFrame:
    """(case, paper_id, chunk_id, score, matched): a paper's best chunk, raised for further ones; `keep` papers a case."""
    got = hits.groupBy("case", "paper_id").agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("chunk_id"), F.max("score").alias("top"), F.count("*").alias("matched"))
    score = F.round(F.col("top") * (1 + S.BOOST * F.least(F.col("matched") - 1, F.lit(S.BOOST_MOST))), S.DIGITS)
    return best(got.select("case", "paper_id", "chunk_id", score.alias("score"), "matched"), keep, F.desc("score"), "paper_id").drop("place")


def over_all(index: SearchIndex, queries: DataFrame, k: int, filters: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(case, paper_id, chunk_id, score, matched) from all chunks, the first of each paper. Under a filter, lists are fetched deep and
    filtered before they are cut."""
    depth = S.FETCH if filters is None else S.OVER_FETCH
    lists = [index.chunks.topk(queries, ONE, depth)]
    if index.chunk_vectors:
        lists.append(index.chunk_vectors.topk(queries, ONE, depth))
    if filters is not None:
        again = Window.partitionBy(*ONE).orderBy("rank")
        owned = [x.select(*ONE, "id", "rank").join(index.owners, "id") for x in lists]
        lists = [passed(x, filters, allowed, "paper_id").withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= S.FETCH) for x in owned]
    pool = best(fused(lists), S.POOL, F.desc("score"), "id").drop("place").join(index.owners, "id")
    first = pool.withColumn("n", F.row_number().over(Window.partitionBy("case", "paper_id").orderBy(F.desc("score"), "id"))).filter("n = 1")
    return best(first, k, F.desc("score"), "paper_id").select("case", "paper_id", F.col("id").alias("chunk_id"), "score", F.lit(1).cast("long").alias("matched"))


def search_all(index: SearchIndex, queries: DataFrame, k: int = 5, filters: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(case, rank, paper_id, chunk_id, score, matched), written: k papers a case in two stages; cases that these leave without a paper
    search all chunks. queries(case, v, text, vector), read several times: a table, or cut()."""
    keep = max(2 * k, 8)
    chosen = cut(candidates(index, queries, filters, allowed), "candidates")
    staged = cut(by_paper(chunk_hits(index, queries, chosen), keep), "staged")
    left = cut(queries.join(staged.select("case").distinct(), "case", "left_anti"), "left")
    every = staged.unionByName(over_all(index, left, keep, filters, allowed)) if not left.isEmpty() else staged
    ranked = best(every, k, F.desc("score"), "paper_id", name="rank")
    return cut(ranked.select("case", "rank", "paper_id", "chunk_id", "score", "matched"), "results")
