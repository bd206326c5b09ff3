"""Substring search ranked by BM25, fusion by reciprocal ranks, and the steps of the two-stage search.

A quoted term of a trigram index is a case-folded substring; its frequency counts overlapping occurrences, and
a row's length is its number of trigrams. No index is kept: one pass over the texts tests all terms of all queries and
is written as a narrow table of lengths and frequencies, from which corpus numbers, scores and fallbacks follow.

Every ranking is rounded before it is ordered and ends in the id, so that equal scores have one order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.scalars import pages_label, search_terms
from quillstack.sources.shared import cut

K1, B = 1.2, 0.75
RRF_K, FETCH, POOL, OVER_FETCH = 60, 30, 20, 200
BOOST, BOOST_MOST = 0.1, 5
DIGITS = 6


def occurrences(text: Column, term: str) -> Column:
    """Overlapping occurrences of a lower-cased term in a lower-cased text."""
    inside = F.contains(text, F.lit(term))
    return F.when(inside, F.regexp_count(text, F.lit(f"(?={_java_quote(term)})"))).otherwise(0).cast("long")


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def scan_terms(rows: DataFrame, asked: Sequence[tuple[Sequence[str], str]], id_col: str = "id", text_col: str = "text", like_cols: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., d, f<q>_<i>, like<q>), written: of each row its length, for each query q the occurrences of its
    terms i, and whether a column (of the text and like_cols) contains the query's whole text. asked: (terms, text)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    d = F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))) - 2, F.lit(0))
    cols = [low, *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in like_cols]]
    found = [occurrences(low, t.lower()).alias(f"f{q}_{i}") for q, (terms, _) in enumerate(asked) for i, t in enumerate(terms)]
    likes = [reduce(lambda a, b: a | b, [F.contains(c, F.lit(text.lower())) for c in cols]).alias(f"like{q}") for q, (_, text) in enumerate(asked)]
    return cut(rows.select(F.col(id_col).alias("id"), *keep, d.alias("d"), *found, *likes), "terms")


def scores(scan: DataFrame, terms: Sequence[str], q: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score): BM25 of a scan's rows that hold a term of query q. allowed(id) restricts rows, not corpus numbers."""
    f = [F.col(f"f{q}_{i}") for i in range(len(terms))]
    stats = scan.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *[F.count_if(x > 0).alias(f"n{i}") for i, x in enumerate(f)])
    found = scan.filter(reduce(lambda a, b: a | b, [x > 0 for x in f], F.lit(False)))
    if allowed is not None:
        found = found.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
    found = found.crossJoin(F.broadcast(stats))  # one row of corpus numbers

    def part(i: int, x: Column) -> Column:
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        return F.when(x > 0, idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("d") / F.col("mean")))).otherwise(0.0)

    score = reduce(lambda a, b: a + b, [part(i, x) for i, x in enumerate(f)], F.lit(0.0))
    return found.select("id", F.round(score, DIGITS).alias("score"))


def bm25(rows: DataFrame, terms: Sequence[str], id_col: str = "id", text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """(id, score): BM25 of the rows that hold a term. allowed(id) restricts the rows, not the corpus numbers."""
    return scores(scan_terms(rows, [(terms, "")], id_col, text_col), terms, 0, allowed)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(id, score, rank): the k best, ranks from 1."""
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # over k rows


def phrase(query: str) -> list[str]:
    """The whole query as one term, if it is long enough for one."""
    return [query] if len(query) >= 3 else []


def lexical_topk(scan: DataFrame, terms: Sequence[str], q: int = 0, k: int = FETCH, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score, rank): the k best rows of query q; where no term has a hit, the first k rows, by id, that contain
    the query's text, with score 0."""
    other = scan.filter(f"like{q}").select("id")
    if allowed is not None:
        other = other.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi")
    other = other.orderBy("id").limit(k).select("id", F.lit(0.0).alias("score"))
    if not terms:
        return ranked(other, k)
    first = scores(scan, terms, q, allowed).orderBy(F.desc("score"), "id").limit(k)
    # The fallback's rows pass only if the first list is empty; both are at most k rows.
    none = first.agg(F.count("*").alias("hits")).filter("hits = 0").select(F.lit(1).alias("go"))
    return ranked(first.unionByName(other.crossJoin(F.broadcast(none)).drop("go")), k)


def phrase_topk(rows: DataFrame, query: str, k: int = FETCH, id_col: str = "id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """The whole query as one phrase; rows that merely contain it where the phrase has no hit."""
    scan = scan_terms(rows, [(phrase(query), query)], id_col, text_col, [title_col] if title_col else [])
    return lexical_topk(scan, phrase(query), 0, k)


def terms_topk(rows: DataFrame, query: str, k: int = FETCH, id_col: str = "id", text_col: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """Any term of the query."""
    return lexical_topk(scan_terms(rows, [(search_terms(query), query)], id_col, text_col), search_terms(query), 0, k, allowed)


def rrf(lists: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): sum of 1 / (k + rank) over ranked lists of (id, rank)."""
    every = reduce(DataFrame.unionByName, [x.select("id", "rank") for x in lists])
    return every.groupBy("id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), DIGITS).alias("score"))


def over_fetch(scored: DataFrame, allowed: DataFrame | None, k: int = FETCH, depth: int = OVER_FETCH) -> DataFrame:
    """Ranked k; under a filter the best `depth` are filtered first."""
    if allowed is None:
        return ranked(scored, k)
    deep = ranked(scored, depth)
    return ranked(deep.join(allowed.select(F.col(allowed.columns[0]).alias("id")), "id", "left_semi").select("id", "score"), k)


def meta_filter(papers: DataFrame, year_min: int | None = None, year_max: int | None = None, author: str | None = None, venue: str | None = None) -> DataFrame | None:
    """(id) of papers within all bounds given; None when there is none. Rows without a year fail either bound;
    patterns take % and _ as wildcards and fold ASCII case."""
    tests = []
    if year_min is not None:
        tests.append(F.col("year") >= year_min)
    if year_max is not None:
        tests.append(F.col("year") <= year_max)
    for col, pattern in (("authors", author), ("venue", venue)):
        if pattern:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), pattern)
            tests.append(F.translate(F.col(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like(f"%{low}%"))
    return papers.filter(reduce(lambda a, b: a & b, tests)).select("id") if tests else None


def in_order(rows: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    """Rows of the given ids, with their place `pos` in the list; missing ids are left out."""
    wanted = rows.sparkSession.createDataFrame([(i, p) for p, i in enumerate(dict.fromkeys(ids))], f"{id_col} long, pos int")
    return rows.join(F.broadcast(wanted), id_col)  # as many rows as the caller has listed


def aggregate_papers(chunks: DataFrame, keep: int, boost: float = BOOST, most: int = BOOST_MOST) -> DataFrame:
    """(paper_id, chunk_id, score, matched) from (paper_id, id, score): the best chunk, raised for further ones."""
    best = chunks.groupBy("paper_id").agg(F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("chunk_id"), F.max("score").alias("top"), F.count("*").alias("matched"))
    score = F.round(F.col("top") * (1 + boost * F.least(F.col("matched") - 1, F.lit(most))), DIGITS)
    return best.select("paper_id", "chunk_id", score.alias("score"), "matched").orderBy(F.desc("score"), "paper_id").limit(keep)


def first_per_paper(chunks: DataFrame, k: int) -> DataFrame:
    """(paper_id, id, score) of each paper's best chunk, k papers."""
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "id"))
    return chunks.withColumn("n", place).filter("n = 1").drop("n").orderBy(F.desc("score"), "paper_id").limit(k)


def hit_cards(hits: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (paper_id, chunk_id, score, matched) with what a result list shows."""
    p = papers.select(F.col("id").alias("paper_id"), "title", "year", "summary", "topics")
    c = chunks.select(F.col("id").alias("chunk_id"), "section", "page_start", "page_end", "text")
    return hits.join(p, "paper_id").join(c, "chunk_id").select(
        "paper_id", "title", "year", F.substring("summary", 1, 500).alias("summary"), "topics", "chunk_id", "section", pages_label(F.col("page_start"), F.col("page_end")).alias("pages"),
        F.round("score", 5).alias("score"), F.col("matched").alias("matched_chunks"), F.substring("text", 1, 400).alias("snippet"),
    )
