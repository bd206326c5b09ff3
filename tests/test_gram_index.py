"""The gram index against brute force: same scores, same fallbacks, after changes too; what a search reads; its stream."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions.scalars import search_terms
from quillstack.operators.gram_index import GramIndex
from quillstack.streaming.arrivals import keep_index

QUERIES = ["thing", "heoron thing", "aaa", "AAaa", "the, an; nothere", "zzz qqq", "ab", "x", "日本", "日本語の", "é b", "  spaced out ", "100% _ \\E \"q\"", "aba", "tail", "", "i̇st"]


def texts(n=120, seed=4):
    r = random.Random(seed)
    words = ["thing", "heoron", "the", "an", "aaaa", "aaaaa", "ababa", "日本語", "日本", "é", "b", "100%", "_", "\\E", '"q"', "Tail", "İstanbul", "x\ny", "spaced", "out"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 40])))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "ab"), (n + 3, "X"), (n + 4, "aaa"), (n + 5, "thing " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def places(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


def brute(rows, query, whole, k=5, allowed=None):
    """From the definition: BM25 over overlapping occurrences, else rows that contain the query."""
    query, rows = query.strip(), {i: (t or "") for i, t in rows}
    inside = {i for i in rows if allowed is None or i in allowed}
    terms = ([query] if len(query) >= 3 else []) if whole else search_terms(query)
    d = {i: max(len(t) - 2, 0) for i, t in rows.items()}
    mean, score = sum(d.values()) / max(1, len(d)), {}
    for term in terms:
        f = {i: n for i, t in rows.items() if (n := places(t.lower(), term.lower()))}
        idf = math.log((len(rows) - len(f) + 0.5) / (len(f) + 0.5))
        for i, n in f.items():
            score[i] = score.get(i, 0) + (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * d[i] / mean))
    hits = sorted(((-round(s, 6), i) for i, s in score.items() if i in inside)) or [(0, i) for i in sorted(inside) if query and query.lower() in rows[i].lower()]
    return sorted((i, pytest.approx(-s, abs=2e-6), n + 1) for n, (s, i) in enumerate(hits[:k]))


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "q long, text string")


def by_query(df):
    out = {q: [] for q in range(len(QUERIES))}
    for r in df.collect():
        out[r["q"]].append((r["id"], r["score"], r["rank"]))
    return {q: sorted(v) for q, v in out.items()}


def check(spark, index, rows, whole=False):
    got = by_query(index.topk(asked(spark), k=5, whole=whole))
    for q, text in enumerate(QUERIES):
        assert got[q] == brute(rows, text, whole), text


@pytest.mark.parametrize("whole", [False, True])
def test_equals_brute_force(spark, tmp_path, whole):
    index = GramIndex.build(frame(spark, texts()), str(tmp_path / "ix"), buckets=8)
    check(spark, index, texts(), whole)


def test_restricted(spark, tmp_path):
    """Each query has its own rows; corpus numbers stay those of all."""
    index = GramIndex.build(frame(spark, texts()), str(tmp_path / "ix"), buckets=8)
    own = {0: list(range(0, 60, 2)), 1: [3, 4, 5], 4: list(range(100)), 6: [122]}
    allowed = spark.createDataFrame([(q, i) for q, ids in own.items() for i in ids], "q long, id long")
    got = by_query(index.topk(asked(spark), k=5, allowed=allowed))
    for q, text in enumerate(QUERIES):
        assert got[q] == (brute(texts(), text, False, allowed=own[q]) if q in own else []), text


def test_changes_and_compaction(spark, tmp_path):
    """Replaced, added and removed rows; an epoch that runs again; all epochs made one."""
    rows = dict(texts())
    index = GramIndex.build(frame(spark, list(rows.items())), str(tmp_path / "ix"), buckets=8)
    first = sorted(os.listdir(tmp_path / "ix/postings/epoch=0"))
    for epoch, (new, gone) in enumerate([({1: "thing new", 2: "", 500: "heoron heoron"}, [3, 4, 900]), ({500: "now the tail", 4: "ab aaaa", 1: None}, [122]), ({}, [125])], 1):
        for _ in range(2):
            index.apply(frame(spark, list(new.items())) if new else frame(spark, rows.items()).limit(0), epoch, frame(spark, [(i, "") for i in gone]).select("id"))
        rows = {i: t for i, t in (rows | new).items() if i not in gone}
        live = index.totals().first()
        d = [max(len(t or "") - 2, 0) for t in rows.values()]
        assert live["rows"] == len(rows) and abs(live["mean"] - sum(d) / len(d)) < 1e-9
        check(spark, index, list(rows.items()))
    assert sorted(os.listdir(tmp_path / "ix/postings/epoch=0")) == first
    one = index.compact(str(tmp_path / "one"))
    assert one.epochs() == [0]
    check(spark, one, list(rows.items()))


def test_reads_its_grams_only(spark, tmp_path):
    """The plan prunes buckets and pushes the grams down; a search reads few of the files."""
    index = GramIndex.build(frame(spark, texts()), str(tmp_path / "ix"), buckets=32)
    hits = index.occurrences(spark.createDataFrame([(0, 0, "thing")], "q long, t int, term string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "PushedFilters: [In(gram, [hin,ing,thi" in plan.replace("[In(gram, [ing,thi]", "[In(gram, [hin,ing,thi")
    every = {os.path.dirname(f) for f in index._read("postings").inputFiles()}
    buckets = {r[0] for r in spark.createDataFrame([("thi",), ("ing",)], "g string").select(F.pmod(F.xxhash64("g"), F.lit(32))).collect()}
    assert len(buckets) <= 2 < 10 < len(every)
    scans = [n for n in _nodes(hits) if n.nodeName().startswith("Scan parquet") and "gram" in n.toString()]
    hits.collect()
    hit_files = sum(n.metrics().apply("numFiles").value() for n in scans if n.metrics().contains("numFiles"))
    assert not scans or hit_files <= len(buckets)


def _nodes(df):
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        out.append(node)
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return out


def test_many_grams(spark, tmp_path, monkeypatch):
    """More grams than a query may list go by the join alone."""
    from quillstack.operators import gram_index

    monkeypatch.setattr(gram_index, "LISTED", 2)
    check(spark, GramIndex.build(frame(spark, texts()), str(tmp_path / "ix"), buckets=8), texts())


def test_stream(spark, tmp_path):
    """After n batches the index answers as one built at once; a batch that runs again changes nothing."""
    rows = dict(texts())
    index = GramIndex.build(frame(spark, list(rows.items())), str(tmp_path / "ix"), buckets=4)
    schema = "id long, text string, version long"
    changes = [[(1, "thing one", 1), (1, "thing two", 2), (700, "heoron", 1)], [(2, None, 3), (701, "aaaa", 1)], [(700, None, 2), (700, "back thing", 3)]]
    for batch in changes:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "land"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "land"))
        keep_index(stream, index, str(tmp_path / "state"), after=0).awaitTermination()
    assert index.epochs() == [0, 1, 2, 3]
    rows |= {1: "thing two", 700: "back thing", 701: "aaaa"}
    del rows[2]
    check(spark, index, list(rows.items()))
    index.apply(frame(spark, [(700, "back thing")]), 3)
    check(spark, index, list(rows.items()))


def test_empty(spark, tmp_path):
    index = GramIndex.build(frame(spark, [(1, "x")]).limit(0), str(tmp_path / "ix"))
    assert index.topk(asked(spark)).collect() == []


def test_index_is_no_larger_than_a_few_texts(spark, tmp_path):
    """Postings hold no places, and what a build shuffles is gone when it ends: the disk it takes stays near that of the texts."""
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(2000)]
    rows = [(i, " ".join(r.choices(words, k=300))) for i in range(400)]
    before = _shuffled(spark)
    GramIndex.build(frame(spark, rows), str(tmp_path / "ix"), buckets=2)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "ix/postings") for f in names)
    assert size < 0.6 * sum(len(t) for _, t in rows)
    assert _shuffled(spark) - before < 100_000


def _shuffled(spark):
    """Bytes of shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum(os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f))


def test_passes(spark, tmp_path, monkeypatch):
    """Postings written in several passes, by a build and by compaction, are those of one."""
    from quillstack.operators import gram_index

    monkeypatch.setattr(gram_index, "ONE_PASS", 1)
    index = GramIndex.build(frame(spark, texts()), str(tmp_path / "ix"), buckets=8)
    index.apply(frame(spark, [(1, "thing new")]), 1)
    check(spark, index.compact(str(tmp_path / "one")), list((dict(texts()) | {1: "thing new"}).items()))


def test_postings_are_lists_of_blocks(spark, tmp_path, monkeypatch):
    """A gram has one row for each block of rows, not one for each row; blocks read in pieces, and terms and queries in parts, change nothing."""
    from quillstack.operators import gram_index

    same = spark.range(3000).selectExpr("id", "concat('thing and other thing ', id % 7) as text").coalesce(1)
    index = GramIndex.build(same, str(tmp_path / "same"), buckets=2)
    lists, held = index._read("postings").agg(F.count("*"), F.sum(F.size("at"))).first()
    assert held > 50_000 and lists <= 40 * (3000 // gram_index.BLOCK + 1)
    monkeypatch.setattr(gram_index, "CHARS", 50)
    monkeypatch.setattr(gram_index, "ASKED", 2)
    rows = [*texts(), (900, "".join(map(chr, range(0x4E00, 0x4F00))) + "\U0001f600\U0001f601\U0001f602 thing")]
    check(spark, GramIndex.build(frame(spark, rows), str(tmp_path / "ix"), buckets=8), rows)
