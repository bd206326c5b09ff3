"""The corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and its result is written and reread as
the next one's docs. All but the last return the columns of docs, in their order, whatever further columns there are and
whatever their names. Every stage gives no rows for an empty table, takes nulls in any column, and decides row by row:
rows that repeat, or repeat an id with another text, are told apart by their text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import linefreq, nearcopies, packing, substrings, toxicity
from quillstack.llm.common import cut, may_hold, quoted, sieve


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic. Null and empty texts score as texts without features;
    equal texts score alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its host's boilerplate lines; n_chars follows the text. A null text stays null; a text
    whose lines all go becomes empty; repeated rows count as documents of their own."""
    out = linefreq.lines_left(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 and more) the document of the smallest id; of rows of one
    id it is the row of the smallest text hash, and rows that repeat id and text are one document. Rows of a null id
    stay. Null, empty and blank texts are copies of each other."""
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    gone = cut(nearcopies.dropped_copies(docs), "copies")
    # Most rows are none of those to drop and stay where they are; the others meet them in a join.
    rows = may_hold(rows, F.xxhash64("doc_id", "th"), sieve(gone.select(F.xxhash64("doc_id", "th").alias("k"))))
    kept = rows.filter("not maybe").union(rows.filter("maybe").join(gone, ["doc_id", "th"], "left_anti").select(rows.columns))
    return kept.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without byte strings that an earlier one has; n_chars follows the text. A null text stays null;
    one that is covered whole becomes empty; rows that repeat id and text get the same result."""
    out = substrings.remove_repeats(docs, carry=True)
    own = {c: F.col(f"row.cols.{quoted(c)}") for c in docs.columns if c != "text"}
    own["text"] = F.when(~F.col("row.no_text"), F.col("text"))
    own["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.cols.n_chars"))
    return out.select(*[own[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces in sequences; a null or empty text is its end token; repeated rows are
    packed apart."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate_lines), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
