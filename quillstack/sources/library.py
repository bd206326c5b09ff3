"""Tables of a library on storage, arrivals of files, evaluation cases, rows from citation APIs, API keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.scalars import author_list, external_id, work_id

SCHEMAS = {
    "papers": "id long, title string, authors string, year int, venue string, doi string, abstract string, summary string, topics string, notes string, sha256 string, engine string, added_at timestamp, citations_fetched_at timestamp, cited_by_count int, kg_built_at timestamp",
    "chunks": "id long, paper_id long, ord int, section string, page_start int, page_end int, text string",
    "chunk_vectors": "id long, embedding array<float>, dim int",
    "paper_vectors": "id long, embedding array<float>, dim int",
    "citations": "cid long, paper_id long, direction string, ext_id string, title string, year int",
    "kg_nodes": "id long, name string, display string, type string, desc string",
    "kg_edges": "src long, dst long, relation string, paper_id long, chunk_id long",
    "kg_chunk_links": "chunk_id long, node_ids array<long>",
}


@dataclass
class Library:
    """A library's tables. Reading is lazy; columns that older files lack come as nulls."""

    papers: DataFrame
    chunks: DataFrame
    chunk_vectors: DataFrame
    paper_vectors: DataFrame
    citations: DataFrame
    kg_nodes: DataFrame
    kg_edges: DataFrame
    kg_chunk_links: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Library:
        return cls(**{t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in SCHEMAS.items()})

    @classmethod
    def empty(cls, spark: SparkSession) -> Library:
        return cls(**{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})

    def write(self, path: str) -> None:
        """Each table once, to a folder that must be new: a library is changed by writing the next one."""
        for t in SCHEMAS:
            getattr(self, t).write.parquet(f"{path}/{t}")


def text_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text, sha256, status, error): files below a folder; one that is no UTF-8 text gets status `error`."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return f.select("path", F.when(ok, text).alias("text"), F.sha2("content", 256).alias("sha256"), F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, "not UTF-8 text").alias("error"))


def write_markdown(texts: DataFrame, path: str) -> None:
    """(sha256, text) as a table of documents' Markdown under short names, `<first 16 digits>.md`; one row a content."""
    texts.select(F.concat(F.substring("sha256", 1, 16), F.lit(".md")).alias("name"), "text").dropDuplicates(["name"]).write.mode("append").parquet(path)


def read_markdown(spark: SparkSession, path: str, sha256: DataFrame, front: int = 4000) -> DataFrame:
    """(sha256, front): the first characters of the Markdown written for each content asked for; null where there is none."""
    own = sha256.select("sha256", F.concat(F.substring("sha256", 1, 16), F.lit(".md")).alias("name"))
    return own.join(spark.read.parquet(path), "name", "left").select("sha256", F.substring("text", 1, front).alias("front"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, expect_any, expect_all, filters) of a JSON file {"cases": [...]}."""
    schema = "cases array<struct<id:string,query:string,expect_any:array<string>,expect_all:array<string>,filters:struct<year_min:int,year_max:int,author:string,venue:string>,note:string>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("cases").alias("c")).select("c.*")


_WORK = "struct<id:string,doi:string,title:string,publication_year:int>"


def works_to_citations(raw: DataFrame, json_col: str = "json", paper_col: str = "paper_id", direction: str = "refs") -> DataFrame:
    """(paper_id, direction, ext_id, title, year) from a citation API's {"results": [works]}; untitled works dropped."""
    w = raw.select(F.col(paper_col).alias("paper_id"), F.explode(F.from_json(F.col(json_col), f"results array<{_WORK}>")["results"]).alias("w"))
    return w.filter(F.trim("w.title") != "").select("paper_id", F.lit(direction).alias("direction"), work_id("w.doi", "w.id").alias("ext_id"), F.col("w.title").alias("title"), F.col("w.publication_year").alias("year"))


def fallback_to_citations(raw: DataFrame, json_col: str = "json", paper_col: str = "paper_id", direction: str = "refs") -> DataFrame:
    """The same from a second API's {"data": [{citedPaper | citingPaper}]}."""
    paper = "struct<paperId:string,title:string,year:int,externalIds:struct<DOI:string,ArXiv:string,CorpusId:string>,authors:array<struct<name:string>>>"
    rows = raw.select(F.col(paper_col).alias("paper_id"), F.explode(F.from_json(F.col(json_col), f"data array<struct<citedPaper:{paper},citingPaper:{paper}>>")["data"]).alias("d"))
    rows = rows.select("paper_id", F.coalesce("d.citedPaper", "d.citingPaper").alias("p")).filter(F.trim("p.title") != "")
    return rows.select("paper_id", F.lit(direction).alias("direction"), external_id("p.externalIds.DOI", "p.externalIds.ArXiv", "p.externalIds.CorpusId", "p.title").alias("ext_id"), F.col("p.title").alias("title"), F.col("p.year").alias("year"), author_list(F.transform("p.authors", lambda a: a["name"]), 1000).alias("authors"))


def usable_keys(keys: DataFrame, exhausted: DataFrame, now: int, ttl: int = 6 * 3600) -> DataFrame:
    """API keys whose fingerprint (12 hex digits of SHA-256) wasn't marked exhausted within the time to live."""
    marked = exhausted.filter(F.col("epoch") > now - ttl).select("fingerprint")
    return keys.withColumn("fingerprint", F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 12)).join(marked, "fingerprint", "left_anti")


def fetch_report(wanted: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(paper_id, source, n): where each wanted paper's citations come from; `none` stays queued."""
    n = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    r = wanted.select(F.col("id").alias("paper_id")).join(n(primary, "a"), "paper_id", "left").join(n(fallback, "b"), "paper_id", "left")
    return r.select("paper_id", F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "fallback").otherwise("none").alias("source"), F.coalesce("a", "b", F.lit(0)).alias("n"))


def fetched(wanted: DataFrame, primary: tuple[DataFrame, DataFrame], fallback: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, found): what two sources say of wanted(id). A source is (rows(cid, paper_id, direction, ext_id, title, year), found(paper_id,
    cited_by_count, authors)), found having the papers that it knows, with citations or without; the first that knows a paper
    speaks for it. found gets `source`."""
    want = wanted.select(F.col("id").alias("paper_id"))
    first = primary[1].join(want, "paper_id", "left_semi").withColumn("source", F.lit("primary"))
    second = fallback[1].join(want, "paper_id", "left_semi").join(first.select("paper_id"), "paper_id", "left_anti").withColumn("source", F.lit("fallback"))
    found = first.unionByName(second)
    of = lambda rows, got: rows.join(got.select("paper_id"), "paper_id", "left_semi").select("cid", "paper_id", "direction", "ext_id", "title", "year")
    return of(primary[0], first).unionByName(of(fallback[0], second)), found


def apply_fetched(papers: DataFrame, citations: DataFrame, wanted: DataFrame, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, citations, report) after a fetch. A found paper's citations are replaced, the first of equal (direction, ext_id) kept,
    even by none; it is stamped, and its count and authors are overwritten where the source has them. Papers that no source knows
    stay unstamped, so that they are asked for again. report: (paper_id, status, source, refs, cited, stored, cited_by_count, authors)."""
    from quillstack.operators.graph import keep_first

    kept = keep_first(rows, ["paper_id", "direction", "ext_id"], ["cid"])
    after = citations.join(found.select("paper_id"), "paper_id", "left_anti").select(citations.columns).unionByName(kept.select(citations.columns))
    f = found.select(F.col("paper_id").alias("id"), F.col("cited_by_count").alias("_n"), F.nullif(F.substring(F.col("authors"), 1, 300), F.lit("")).alias("_a"), F.lit(True).alias("_f"))
    new = papers.join(f, "id", "left").withColumns({"cited_by_count": F.coalesce("_n", "cited_by_count"), "authors": F.coalesce("_a", "authors"), "citations_fetched_at": F.when(F.col("_f"), F.current_timestamp()).otherwise(F.col("citations_fetched_at"))})
    said = rows.groupBy("paper_id").agg(F.count_if(F.col("direction") == "refs").alias("refs"), F.count_if(F.col("direction") == "cited").alias("cited"))
    stored = kept.groupBy("paper_id").agg(F.count("*").alias("stored"))
    report = wanted.select(F.col("id").alias("paper_id")).join(found, "paper_id", "left").join(said, "paper_id", "left").join(stored, "paper_id", "left")
    report = report.select("paper_id", F.when(F.col("source").isNull(), "not_found").otherwise("ok").alias("status"), F.coalesce("source", F.lit("fallback")).alias("source"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("refs", "cited", "stored")], "cited_by_count", F.coalesce("authors", F.lit("")).alias("authors"))
    return new.select(papers.columns), after, report
