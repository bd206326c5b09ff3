"""What a library holds: counts, gaps, spans, topics, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.scalars import is_blank, parse_topics, raw_tokens, topic_term
from quillstack.sources.shared import cut


def library_stats(papers: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: papers, chunks, embedded."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(papers, "papers").crossJoin(one(chunks, "chunks")).crossJoin(one(vectors, "embedded"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"))


def year_span(papers: DataFrame) -> DataFrame:
    return papers.agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count("year").alias("with_year"), F.count("*").alias("papers"))


def gaps(papers: DataFrame) -> DataFrame:
    """One row of counts: papers without authors, summary, year, concept graph, citations."""
    none = lambda c: F.count_if(F.col(c).isNull())
    return papers.agg(F.count_if(is_blank("authors")).alias("no_authors"), F.count_if(is_blank("summary")).alias("no_summary"), none("year").alias("no_year"), none("kg_built_at").alias("no_kg"), none("citations_fetched_at").alias("no_citations"))


def representatives(papers: DataFrame, chunks: DataFrame, k: int = 8) -> DataFrame:
    """Papers with a summary first, then by chunks, year and id."""
    p = papers.join(chunk_counts(chunks).withColumnRenamed("paper_id", "id"), "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))
    return p.withColumn("has_summary", (~is_blank("summary")).cast("int")).orderBy(F.desc("has_summary"), F.desc("n_chunks"), F.desc(F.coalesce("year", F.lit(0))), "id").limit(k).select("id", "title", "year", "has_summary", "n_chunks")


def recent(papers: DataFrame, k: int = 5) -> DataFrame:
    return papers.orderBy(F.desc("added_at"), F.desc("id")).limit(k)


def topic_counts(papers: DataFrame, *cols: str) -> DataFrame:
    """(term, n_occurrences, n_documents) over the text columns; spellings in different case are apart."""
    text = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in cols])
    terms = F.filter(F.transform(raw_tokens(text), topic_term), lambda t: t.isNotNull())
    # Both counts are sums over terms, so only terms are shuffled, summed before.
    one = lambda said, held: lambda t: F.struct(t.alias("term"), F.lit(said).alias("o"), F.lit(held).alias("d"))
    found = papers.select(terms.alias("t")).select(F.explode(F.concat(F.transform("t", one(1, 0)), F.transform(F.array_distinct("t"), one(0, 1)))).alias("x")).select("x.*")
    return found.groupBy("term").agg(F.sum("o").alias("n_occurrences"), F.sum("d").alias("n_documents"))


def text_topics(counts: DataFrame, k: int = 12, pool: int = 512) -> list[tuple[str, int]]:
    """The k most frequent terms, none a spelling or part of one kept (of four characters at least) before it.

    The rule is sequential; it reads the ranked terms in pages until k are kept, so that it never needs them all.
    """
    order = [F.desc("n_occurrences"), F.desc(F.length("term")), F.lower("term"), "term"]
    kept: list[tuple[str, int]] = []
    lowered: list[str] = []
    seen = 0
    counts = cut(counts, "topics")
    while True:
        rows = counts.orderBy(*order).limit(seen + pool).collect()[seen:]
        for r in rows:
            low = r["term"].lower()
            if low in lowered or any(low in s for s in lowered if len(s) >= 4):
                continue
            kept.append((r["term"], r["n_occurrences"]))
            lowered.append(low)
            if len(kept) >= k:
                return kept
        if len(rows) < pool:
            return kept
        seen, pool = seen + pool, 2 * (seen + pool)


def user_tags(papers: DataFrame, k: int = 16) -> DataFrame:
    """(tag, n): tags in the spelling seen first (by paper id, then place), counted regardless of case."""
    tags = papers.select("id", F.posexplode(parse_topics("topics")).alias("pos", "tag"))
    return tags.groupBy(F.lower("tag").alias("key")).agg(F.min_by("tag", F.struct("id", "pos")).alias("tag"), F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k).select("tag", "n")


def citation_counts(citations: DataFrame, paper_id: int) -> DataFrame:
    return citations.filter(F.col("paper_id") == paper_id).groupBy("direction").agg(F.count("*").alias("n"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster")


def direction_sentence(tags: list[str], concepts: list[str], terms: list[str]) -> str:
    """What the library is about: user tags, else concepts, else frequent terms."""
    for names, most in ((tags, 8), (concepts, 6), (terms, 8)):
        if names:
            return "Library on " + ", ".join(names[:most])
    return "Library without topics yet"
