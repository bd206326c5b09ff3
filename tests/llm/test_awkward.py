"""Every operator and stage on tables with clashing column names, no rows, and ids that repeat with other texts."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.llm import bytebpe, divergence, fingerprints, hilbert, licenses, linefreq, packing, pieces, simhash, substrings, topk, toxicity, variants

from .helpers import DATA

NAMES = "_kept _n_lines _n_dropped _host _keys _left _id no_text a.b row cols th sig key its host keys kept text_ left places h x jlo rep component component_id block ord rank sub curve score n_words tgram kind w pos spans sth copy doc kdoc kth `q`".split()
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS * 30)
ROWS = [(1, LONG), (2, LONG + " more"), (2, "another text under the MIT license"), (2, "another text under the MIT license"), (3, None), (4, ""), (None, "no id"), (5, "you idiot"), (6, LONG[100:900])]


def table(spark, rows, clash):
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(f"value of {n}").alias(n) for n in NAMES]) if clash else df


WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SEED = toxicity.Model({"idiot": 4.0}, -2.0)
OPERATORS = {
    "op1": fingerprints.fingerprint_with_edits, "op1 anchors": fingerprints.anchors, "op3": simhash.near_duplicates, "op4": hilbert.curve_shards, "op5": lambda d: pieces.encode_report(d, PIECE),
    "op5 ids": lambda d: pieces.encode_documents(d, PIECE), "op6": lambda d: linefreq.lines_left(d).select("row.doc_id", "row.text", "kept", "n_lines", "n_dropped"), "op7": lambda d: toxicity.score_documents(d, SEED),
    "op12": lambda d: bytebpe.encode_report(d, BYTES, public_tokenizers.PATTERN), "op12 ids": lambda d: bytebpe.encode_documents(d, BYTES, public_tokenizers.PATTERN),
    "op8": substrings.remove_repeats, "op9": licenses.scan, "op10": lambda d: packing.pack_documents(d, WORD).drop("sequence_id", "offset"),
}
ORDER = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run = OPERATORS[name]
    plain, clash = (ORDER(tuple(r) for r in run(table(spark, ROWS, c)).collect()) for c in (False, True))
    assert clash == plain and len({r[0] for r in plain} | {None, 3, 4}) == 7
    assert run(table(spark, [], True)).collect() == []


WITHOUT_IDS = {"op11": lambda d: divergence.source_divergence(d.withColumn("source", F.when(F.col("doc_id") == 1, "a")), min_docs=1), "op13": variants.spelling_variants}


@pytest.mark.parametrize("name", WITHOUT_IDS)
def test_operator_without_ids(spark, name):
    run = WITHOUT_IDS[name]
    plain, clash = (ORDER(tuple(r) for r in run(table(spark, ROWS, c)).collect()) for c in (False, True))
    assert clash == plain and plain
    assert run(table(spark, [], True)).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stage(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    plain, clash = (stage(spark, table(spark, ROWS, c), DATA) for c in (False, True))
    assert clash.columns == table(spark, ROWS, True).columns
    rows = [r.asDict() for r in clash.collect()]
    assert ORDER(tuple(r[c] for c in plain.columns) for r in rows) == ORDER(tuple(r) for r in plain.collect())
    assert all(r[n] == f"value of {n}" for r in rows for n in NAMES)
    assert stage(spark, table(spark, [], True), DATA).collect() == []


def test_drop_lines_keeps_columns(spark):
    """Columns of the names that drop_lines() gives to its own stay."""
    got = linefreq.drop_lines(table(spark, ROWS, True))
    r = got.filter("doc_id = 1").first()
    assert r["_kept"] == "value of _kept" and r["__kept"] == LONG and r["__n_dropped"] == 0


def test_stages_decide_by_row(spark):
    """Rows of one id with different texts: near-dedup drops the copy only, others treat each text."""
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, ROWS, False), DATA).collect()
    assert ORDER((r.doc_id, r.text) for r in kept) == ORDER([ROWS[0], ROWS[2], ROWS[3], ROWS[4], ROWS[6], ROWS[7]])  # 6 says the words of 1 in the same order, again and again
    left = [r.text for r in corpus_pipeline.drop_repeated_passages(spark, table(spark, ROWS, False), DATA).filter("doc_id = 2").collect()]
    assert sorted(left) == [ROWS[2][1], ROWS[2][1], "more"]


def test_empty_packing_and_vectors(spark):
    assert corpus_pipeline.pack(spark, table(spark, [], True), DATA).collect() == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, score long, block int, v int, rank int, `a.b` int")
    assert topk.search(topk.build_index(topk.quantise(none)), topk.quantise(none)).collect() == []


def test_skewed_ids(spark):
    """Ids in clusters far apart do not share one block."""
    rows = spark.range(4000).select(F.col("id").alias("ord")).union(spark.sql("select 1000000000000 as ord")).union(spark.sql("select explode(sequence(5000000000000000, 5000000000003999)) as ord"))
    blocked, n = fingerprints.id_blocks(rows, most=64, size=100)
    held = [r["count"] for r in blocked.groupBy("block").count().collect()]
    assert sum(held) == 8001 and max(held) <= 4 * 8001 / 64 + 1 and len(held) <= n
    b = blocked.orderBy("ord").toPandas()["block"]
    assert (b.diff().fillna(0) >= 0).all()


def test_hilbert_quantiles(spark, tmp_path):
    """Names that begin alike lie in cells of their own; zone maps bound the shards; written shards read back in order."""
    rows = [(i, "t" * (i % 50), "en", f"https://host{i % 29:02d}.example/", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.curve_shards(df)
    cells = got.join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.collect_set("source_cell").alias("c")).collect()
    assert len({r["c"][0] for r in cells}) == 29 and all(len(r["c"]) == 1 for r in cells)
    zones = {r["shard"]: r for r in hilbert.zone_map(got).collect()}
    for r in got.collect():
        z = zones[r["shard"]]
        assert all(z[f"{c}_min"] <= r[c] <= z[f"{c}_max"] for c in ("lang_cell", "source_cell", "size_cell"))
    assert sum(z["n_rows"] for z in zones.values()) == 400 and set(zones) == set(range(8))
    width = sum(z["source_cell_max"] - z["source_cell_min"] for z in zones.values())
    assert width < 8 * 20  # shards cover parts of the dimension, so that readers can skip some
    hilbert.write_shards(got, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert ORDER((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == ORDER((r["doc_id"], r["shard"], r["slot"]) for r in got.collect())
