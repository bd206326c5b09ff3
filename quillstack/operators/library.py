"""Reading and changing a library's tables; a change is a new table from the old one and a delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.functions.scalars import index_text, is_blank, normalize_topics, strip

from .numbering import numbered

WINDOW, STEP = 1800, 1600


def missing(rows: DataFrame, index: DataFrame, id_col: str = "id", index_id: str = "id") -> DataFrame:
    """Rows that an index has no entry for."""
    return rows.join(index.select(F.col(index_id).alias(id_col)), id_col, "left_anti")


def work_queue(papers: DataFrame, stamp_col: str) -> DataFrame:
    """Papers not yet stamped, by id."""
    return papers.filter(F.col(stamp_col).isNull()).orderBy("id")


def with_text(papers: DataFrame, col: str) -> DataFrame:
    return papers.filter(F.trim(F.col(col)) != "")


def read_section(chunks: DataFrame, paper_id: int, section: str | None = None) -> DataFrame:
    """A paper's chunks in order, of sections whose path contains the text."""
    c = chunks.filter(F.col("paper_id") == paper_id)
    return (c if not section else c.filter(F.contains(F.lower("section"), F.lit(section.lower())))).orderBy("ord")


def section_text(chunks: DataFrame, most: int = 6000) -> DataFrame:
    """(paper_id, text, total): chunks joined under their headings, cut to `most` characters."""
    page = F.when(F.col("page_start").isNotNull(), F.concat(F.lit(" | p"), F.col("page_start").cast("string"))).otherwise("")
    part = F.concat(F.lit("["), F.col("section"), page, F.lit("]\n"), F.col("text"))
    whole = chunks.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n")
    return whole.select("paper_id", text.alias("whole")).select("paper_id", F.substring("whole", 1, most).alias("text"), F.length("whole").cast("long").alias("total"))


def sections(chunks: DataFrame, paper_id: int, most: int = 30) -> DataFrame:
    """(section, page_start) in reading order."""
    return chunks.filter(F.col("paper_id") == paper_id).groupBy("section").agg(F.min("page_start").alias("page_start"), F.min("ord").alias("first")).orderBy("first").limit(most)


def window_chunks(docs: DataFrame, id_col: str = "id", text_col: str = "text", size: int = WINDOW, step: int = STEP) -> DataFrame:
    """(paper_id, ord, text) of unstructured text: whole up to `size` characters, else overlapping windows, stripped,
    empty ones dropped. The last window may lie wholly inside the one before."""
    # Pieces of one step each come in one pass over the text; a window is a piece and the start of the next.
    pieces = F.when(F.length(text_col) <= size, F.array(text_col)).otherwise(F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    cut = docs.select(F.col(id_col).alias("paper_id"), pieces.alias("p")).select("paper_id", F.posexplode(F.transform("p", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get("p", i + 1), F.lit("")), 1, size - step)))).alias("ord", "t"))
    return cut.select("paper_id", "ord", strip("t").alias("text")).filter("text <> ''")


def dedup_files(arrivals: DataFrame, known: DataFrame | None = None, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Arrivals with sha256 and status: `ok` for the first of each content not known yet, else `duplicate`."""
    a = arrivals.withColumn("sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    first = a.groupBy("sha256").agg(F.min(id_col).alias("first"))
    if known is not None:
        first = first.join(known.select("sha256", F.lit(1).alias("old")).distinct(), "sha256", "left")
    else:
        first = first.withColumn("old", F.lit(None).cast("int"))
    fresh = (F.col(id_col) == F.col("first")) & F.col("old").isNull()
    return a.join(first, "sha256").withColumn("status", F.when(fresh, "ok").otherwise("duplicate")).drop("old")


def annotate(papers: DataFrame, delta: DataFrame, merge: bool = True) -> DataFrame:
    """Papers with topics and notes changed by delta(id, topics, notes): null keeps, an empty text clears; merged
    topics follow those there. Adds `changed`; index_text is made anew."""
    d = delta.select("id", F.col("topics").alias("_t"), F.col("notes").alias("_n"))
    p = papers.join(d, "id", "left")
    added = F.concat_ws(";", F.coalesce("topics", F.lit("")), "_t") if merge else F.col("_t")
    topics = F.when(F.col("_t").isNull(), F.col("topics")).otherwise(normalize_topics(added))
    notes = F.when(F.col("_n").isNull(), F.col("notes")).otherwise(F.substring("_n", 1, 2000))
    p = p.withColumns({"topics2": topics, "notes2": notes})
    changed = ~(F.col("topics2").eqNullSafe(F.col("topics")) & F.col("notes2").eqNullSafe(F.col("notes")))
    p = p.withColumn("changed", changed).drop("topics", "notes", "_t", "_n").withColumnsRenamed({"topics2": "topics", "notes2": "notes"})
    return p.withColumn("index_text", index_text("title", "authors", "topics", "abstract", "summary"))


def replace_rows(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table without the keys of `fresh`, and `fresh`."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(table.columns))


def insert_or_ignore(table: DataFrame, fresh: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    from .graph import keep_first

    return table.unionByName(keep_first(fresh, keys, order).join(table.select(*keys), keys, "left_anti").select(table.columns))


def insert_or_replace(table: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of fresh rows with equal keys the last wins, and over the table's."""
    names = [c for c in table.columns if c not in keys]
    last = fresh.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in names])
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(table.columns))


def upsert_index(index: DataFrame, delta: DataFrame) -> DataFrame:
    """An index of (id, embedding, ...) after delta(id, embedding): entries replaced or added, removed where the new
    vector is null."""
    return replace_rows(index, delta, "id").filter("embedding is not null")


def delete_papers(table: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def update_points(papers: DataFrame, delta: DataFrame) -> DataFrame:
    """Point updates of delta(id, authors?, title?, cited_by_count?, kg_built_at?): null keeps."""
    widths = {"authors": 300, "title": 200}
    cols = [c for c in delta.columns if c != "id"]
    p = papers.join(delta.select("id", *[F.col(c).alias(f"_{c}") for c in cols]), "id", "left")
    new = {c: F.coalesce(F.substring(f"_{c}", 1, widths[c]) if c in widths else F.col(f"_{c}"), F.col(c)) for c in cols}
    return p.withColumns(new).select(papers.columns)


def enrich(papers: DataFrame, lookup: DataFrame, force: bool = False) -> DataFrame:
    """Fill empty authors, year and summary from lookup(id, authors, year, summary); status `updated` or `skip`."""
    p = papers.join(lookup.select("id", *[F.col(c).alias(f"_{c}") for c in ("authors", "year", "summary")]), "id", "left")
    text = lambda c: F.when((is_blank(c) | F.lit(force)) & ~is_blank(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c))
    year = F.coalesce("_year", "year") if force else F.coalesce("year", "_year")
    new = {"authors": text("authors"), "year": year, "summary": text("summary")}
    same = [v.eqNullSafe(F.col(c)) for c, v in new.items()]
    status = F.when(same[0] & same[1] & same[2], "skip").otherwise("updated")
    return p.withColumn("status", status).withColumns(new).select(*papers.columns, "status")


def refresh_metadata(papers: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """Replace titles and authors by better ones of found(id, title, authors); papers not found: `no_markdown`."""
    p = papers.join(found.select("id", F.col("title").alias("_title"), F.col("authors").alias("_authors"), F.lit(True).alias("_got")), "id", "left")
    longer = lambda c, by: F.length(F.coalesce(F.col(f"_{c}"), F.lit(""))) > F.length(F.coalesce(F.col(c), F.lit(""))) + by
    f = F.lit(force)
    title = ~is_blank("_title") & (F.col("_title") != "untitled") & (f | longer("title", 4) | is_blank("title") | (F.col("title") == "untitled"))
    authors = ~is_blank("_authors") & (f | is_blank("authors") | longer("authors", 0))
    new = {"title": F.when(title, F.substring("_title", 1, 200)).otherwise(F.col("title")), "authors": F.when(authors, F.substring("_authors", 1, 300)).otherwise(F.col("authors"))}
    changed = ~(new["title"].eqNullSafe(F.col("title")) & new["authors"].eqNullSafe(F.col("authors")))
    status = F.when(F.col("_got").isNull(), "no_markdown").when(changed, "updated").otherwise("skip")
    return p.withColumn("status", status).withColumns(new).select(*papers.columns, "status")


def new_ids(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """rows with ids following the table's largest, in the order of the key, which tells rows apart. Only keys are ordered."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = numbered(rows.select(*key), key).crossJoin(F.broadcast(top)).select(*key, (F.col("place") + F.col("top")).alias("id"))
    return rows.join(ids, key)
