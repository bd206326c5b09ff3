"""From texts to a library's rows: hash, duplicates, metadata, chunks, vectors, index text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack import hooks
from quillstack.functions import scalars as X
from quillstack.functions.front import front_matter
from quillstack.functions.text import chunk_documents
from quillstack.operators.library import dedup_files, missing, new_ids
from quillstack.sources.library import SCHEMAS, Library
from quillstack.sources.shared import cut


def ingest(lib: Library, arrivals: DataFrame, embedder: hooks.Embedder | None = None, summarize=None) -> tuple[Library, DataFrame]:
    """The library with the arrivals(path, text, status) added, and a report (path, status, paper_id, n_chunks).

    Contents known already or arriving twice are `duplicate`; arrivals in `error` are reported and left out.
    Chunk ids follow from paper ids, so each table is one pass over the new texts.
    """
    spark = arrivals.sparkSession
    good = dedup_files(arrivals.filter("status = 'ok'"), lib.papers, "text", "path")
    fresh = cut(new_ids(good.filter("status = 'ok'").select("path", "text", "sha256"), lib.papers, ["path", "sha256"]), "arrivals")
    front = front_matter(fresh)
    summary = hooks.map_text(summarize)("text") if summarize else F.lit("")
    papers = fresh.join(front.withColumnRenamed("paper_id", "id"), "id").select(
        "id", "title", "authors", X.extract_year("text").alias("year"), F.lit("").alias("venue"), X.extract_doi("text").alias("doi"), X.extract_abstract("text").alias("abstract"), summary.alias("summary"),
        F.lit("").alias("topics"), F.lit("").alias("notes"), "sha256", F.lit("local").alias("engine"), F.current_timestamp().alias("added_at"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("citations_fetched_at", "timestamp"), ("cited_by_count", "int"), ("kg_built_at", "timestamp"))],
    )
    chunks = cut(chunk_documents(fresh).select((F.col("paper_id") * 1_000_000 + F.col("ord")).alias("id"), "paper_id", "ord", "section", "page_start", "page_end", "text"), "arrivals")
    vectors = lambda rows: hooks.embed_rows(rows, embedder).filter("embedding is not null").withColumn("dim", F.size("embedding")) if embedder else spark.createDataFrame([], SCHEMAS["chunk_vectors"])
    indexed = papers.select("id", F.substring(X.index_text("title", "authors", "topics", "abstract", "summary"), 1, 2000).alias("text"))
    report = arrivals.select("path", F.col("status").alias("arrived")).join(good.select("path", "status", "sha256"), "path", "left")
    report = report.join(fresh.select("path", F.col("id").alias("paper_id")), "path", "left").join(chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks")), "paper_id", "left")
    report = report.select("path", F.coalesce("status", "arrived").alias("status"), "paper_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    new = Library(lib.papers.unionByName(papers), lib.chunks.unionByName(chunks), lib.chunk_vectors.unionByName(vectors(chunks)), lib.paper_vectors.unionByName(vectors(indexed)), lib.citations, lib.kg_nodes, lib.kg_edges, lib.kg_chunk_links)
    return new, report


def backfill(lib: Library, embedder: hooks.Embedder) -> Library:
    """The library with vectors for papers and chunks that have none."""
    text = lib.papers.select("id", F.substring(X.index_text("title", "authors", "topics", "abstract", "summary"), 1, 2000).alias("text"))
    made = lambda rows, index: index.unionByName(hooks.embed_rows(missing(rows, index), embedder).filter("embedding is not null").withColumn("dim", F.size("embedding")))
    return Library(**{**lib.__dict__, "paper_vectors": made(text, lib.paper_vectors), "chunk_vectors": made(lib.chunks.select("id", "text"), lib.chunk_vectors)})


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))
