"""The search plan: expand, filter, candidates by paper, hits by chunk, boost, rerank, cards, global fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack import hooks
from quillstack.functions.scalars import index_text, search_terms
from quillstack.operators import search as S
from quillstack.operators.vectors import vector_topk
from quillstack.sources.shared import cut

#: A query and its vector, or None without an embedder.
Variant = tuple[str, Sequence[float] | None]


def variants(query: str, embedder: hooks.Embedder | None = None, rewriter: hooks.Rewriter | None = None) -> list[Variant]:
    texts = hooks.expand_query(query, rewriter)
    return list(zip(texts, embedder(texts))) if embedder else [(t, None) for t in texts]


def candidates(papers: DataFrame, vectors: DataFrame | None, asked: list[Variant], allowed: DataFrame | None = None, pool: int = S.POOL, parity: bool = True) -> DataFrame:
    """(id, score) of the best papers. papers(id, title, index_text), vectors(id, embedding).

    parity filters after the lists are cut to their length, else each list holds allowed papers only.
    """
    rows = papers if parity or allowed is None else papers.join(allowed, "id", "left_semi")
    scan = S.scan_terms(rows, [(S.phrase(text), text) for text, _ in asked], "id", "index_text", ["title"])
    lists = []
    for q, (text, vector) in enumerate(asked):
        lists.append(S.lexical_topk(scan, S.phrase(text), q))
        if vector is not None and vectors is not None:
            lists.append(vector_topk(vectors, vector, S.FETCH, allowed=None if parity else allowed))
    fused = S.rrf(lists)
    if allowed is not None and parity:
        fused = fused.join(allowed, "id", "left_semi")
    return fused.orderBy(F.desc("score"), "id").limit(pool)


def scan_chunks(chunks: DataFrame, asked: list[Variant]) -> DataFrame:
    """One pass over the chunks for all variants."""
    return S.scan_terms(chunks, [(search_terms(text), text) for text, _ in asked], keep=["paper_id"])


def chunk_hits(chunks: DataFrame, vectors: DataFrame | None, asked: list[Variant], chosen: DataFrame) -> DataFrame:
    """(paper_id, id, score): chunks of the chosen papers, fused over all variants."""
    scan = scan_chunks(chunks, asked)
    inside = scan.join(chosen.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").select("id", "paper_id")
    lists = []
    for q, (text, vector) in enumerate(asked):
        lists.append(S.lexical_topk(scan, search_terms(text), q, allowed=inside.select("id")))
        if vector is not None and vectors is not None:
            lists.append(vector_topk(vectors, vector, S.FETCH, allowed=inside.select("id")))
    return S.rrf(lists).join(inside, "id").select("paper_id", "id", "score")


def two_stage(papers, chunks, paper_vectors, chunk_vectors, asked: list[Variant], k: int = 5, allowed: DataFrame | None = None, parity: bool = True) -> DataFrame:
    """(paper_id, chunk_id, score, matched): max(2k, 8) papers by their best chunk."""
    # A list of candidates that later steps read again and again.
    chosen = cut(candidates(papers, paper_vectors, asked, allowed, parity=parity), "candidates")
    return S.aggregate_papers(chunk_hits(chunks, chunk_vectors, asked, chosen), max(2 * k, 8))


def global_search(chunks: DataFrame, vectors: DataFrame | None, asked: list[Variant], k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """(paper_id, chunk_id, score, matched): over all chunks, the first of each paper."""
    scan = scan_chunks(chunks, asked)
    inside = None if allowed is None else scan.join(allowed.select(F.col("id").alias("paper_id")), "paper_id", "left_semi").select("id")
    lists = []
    for q, (text, vector) in enumerate(asked):
        found = S.lexical_topk(scan, search_terms(text), q, S.FETCH if inside is None else S.OVER_FETCH)
        lists.append(found if inside is None else S.over_fetch(found.select("id", "score"), inside))
        if vector is not None and vectors is not None:
            near = vector_topk(vectors, vector, S.FETCH if inside is None else S.OVER_FETCH).select("id", F.col("sim").alias("score"))
            lists.append(S.over_fetch(near, inside))
    pool = S.rrf(lists).orderBy(F.desc("score"), "id").limit(S.POOL).join(scan.select("id", "paper_id"), "id")
    if allowed is not None:
        pool = pool.join(allowed.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    first = S.first_per_paper(pool.select("paper_id", "id", "score"), k)
    return first.select("paper_id", F.col("id").alias("chunk_id"), "score", F.lit(1).cast("long").alias("matched"))


def rerank(hits: DataFrame, chunks: DataFrame, query: str, reranker: hooks.Reranker | None, k: int) -> DataFrame:
    """The first k hits in the reranker's order; without one, or where it fails, in their own. Scores stay."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "paper_id"))  # over a result list
    hits = hits.withColumn("place", place)
    if reranker is None:
        return hits.filter(F.col("place") <= k)
    rows = hits.join(chunks.select(F.col("id").alias("chunk_id"), F.substring("text", 1, 1500).alias("t")), "chunk_id").orderBy("place").collect()
    try:
        got = {r["index"]: r["score"] for r in reranker(query, [r["t"] for r in rows], k)}
    except Exception:
        got = {}
    order = sorted(range(len(rows)), key=lambda i: (-got.get(i, 0.0), i))[:k]
    new = hits.sparkSession.createDataFrame([(rows[i]["paper_id"], n + 1) for n, i in enumerate(order)], "paper_id long, place int")
    return hits.drop("place").join(F.broadcast(new), "paper_id")


def search(spark: SparkSession, lib, query: str, k: int = 5, embedder=None, reranker=None, rewriter=None, per_paper: bool = True, backfill: bool = False, **filters) -> DataFrame:
    """Cards of the k best papers of a Library. Filters: year_min, year_max, author, venue. backfill: papers without a vector get one
    for this search (plans.ingest.backfill() keeps them)."""
    asked = variants(query, embedder, rewriter)
    allowed = S.meta_filter(lib.papers, **filters)
    papers = with_index_text(lib.papers)
    own = with_missing_vectors(papers, lib.paper_vectors, embedder) if backfill and embedder and per_paper else lib.paper_vectors
    found = two_stage(papers, lib.chunks, own, lib.chunk_vectors, asked, k, allowed) if per_paper else None
    if found is None or found.isEmpty():  # the one decision that needs an action
        found = global_search(lib.chunks, lib.chunk_vectors, asked, max(2 * k, 8), allowed)
    best = rerank(found, lib.chunks, query, reranker, k)
    return S.hit_cards(best.drop("place"), lib.papers, lib.chunks)


def with_index_text(papers: DataFrame) -> DataFrame:
    return papers.withColumn("index_text", index_text("title", "authors", "topics", "abstract", "summary"))


def with_missing_vectors(papers: DataFrame, vectors: DataFrame, embedder: hooks.Embedder) -> DataFrame:
    """(id, embedding): the vectors, and new ones for papers that have none, from the first 2000 characters of their index text."""
    rows = papers.join(vectors.select("id"), "id", "left_anti").select("id", F.substring("index_text", 1, 2000).alias("text"))
    new = cut(hooks.embed_rows(rows, embedder), "vectors").filter("embedding is not null")
    return vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(new.select("id", F.col("embedding").cast("array<double>").alias("embedding")))


def semantic_neighbors(vectors: DataFrame, papers: DataFrame, paper_id: int, query: Sequence[float], k: int = 5) -> DataFrame:
    """(id, title, year, similarity): of the 2k nearest other papers, k that exist."""
    near = vector_topk(vectors, query, 2 * k, exclude=paper_id)
    return near.join(papers.select("id", "title", "year"), "id").orderBy(F.desc("sim"), "id").limit(k).select("id", "title", "year", F.round("sim", 3).alias("similarity"))


def related(lib, paper_id: int, query: Sequence[float] | None, k: int = 5) -> DataFrame:
    """(relation, id, similarity): cites, cited_by, semantic."""
    from quillstack.operators.graph import library_neighbors, resolve_citations

    own = lib.citations.filter(F.col("paper_id") == paper_id)
    cited = library_neighbors(resolve_citations(own, lib.papers), paper_id).withColumn("similarity", F.lit(None).cast("double"))
    if query is None:
        return cited
    near = semantic_neighbors(lib.paper_vectors, lib.papers, paper_id, query, k)
    return cited.union(near.select(F.lit("semantic"), "id", "similarity"))
