"""Line dedup by site-relative frequency, with DataFrame functions only.

Per host, the share of its documents that contain a line; lines above a ratio are boilerplate and go. Lines are
compared without surrounding blanks, blank lines always stay, and a line must stand in MIN_PAGES documents,
or every line of a one-page site would go. Lines meet as 128 hash bits, aggregated before the shuffle.

Defined results: null text counts as empty (no lines) and comes back null; null hosts form one host of their
own; repeated rows count as documents of their own; a text whose lines all go becomes empty; an empty table gives no
rows; of hosts with fewer than MIN_PAGES documents no line goes; other columns stay as they are, under any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted

RATIO, MIN_PAGES = 0.05, 5


def _host(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit("\u0000"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, "^[ \\t\\r]+|[ \\t\\r]+$", "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys array<struct<h,g>>): each host's boilerplate lines. A host of L lines a page on average has
    at most L / ratio of them, so the arrays are small whatever the number of pages."""
    host = _host(host_col)
    pages = docs.select(host.alias("host"), F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col(quoted(text_col))), _bare), lambda x: x != ""), _key)).alias("keys"))
    totals = docs.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    often = seen.join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def lines_left(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, kept, n_lines, n_dropped): the input row as a struct, the text left, and counts of its lines.

    The hosts' line sets are written out; the planner broadcasts that table if its size allows, and otherwise
    joins on the host, where adaptive execution splits a large one.
    """
    sets = cut(boilerplate(docs, host_col, text_col, ratio, min_pages), "lines").withColumnRenamed("host", "its")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), _host(host_col).alias("host"), F.col(quoted(text_col)).alias("text"))
    out = rows.join(sets, F.col("host") == F.col("its"), "left")
    lines = _lines(F.col("text"))
    left = F.when(F.col("keys").isNotNull(), F.filter(lines, lambda x: ~F.array_contains(F.col("keys"), _key(_bare(x))))).otherwise(lines)
    n = F.coalesce(F.size(lines), F.lit(0))
    full = F.col("text").isNotNull() & (F.col("text") != "")
    out = out.withColumn("left", left)
    return out.select("row", F.array_join("left", "\n").alias("kept"), F.when(full, n).otherwise(0).cast("long").alias("n_lines"), F.when(full, n - F.size("left")).otherwise(0).cast("long").alias("n_dropped"))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with three columns more: _kept (the text left), _n_lines, _n_dropped. Where docs has a column of such a
    name, it stays, and the new one gets a further underscore, or as many as it takes."""
    names, taken = [], {c.lower() for c in docs.columns}
    for c in ("_kept", "_n_lines", "_n_dropped"):
        while c in taken:
            c = "_" + c
        names.append(c)
    out = lines_left(docs, host_col, text_col, ratio, min_pages)
    return out.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("kept", "n_lines", "n_dropped"), names)])
