import math
import random

import pytest
from pyspark.sql import functions as F

from quillstack import hooks, render
from quillstack.operators import evaluate
from quillstack.operators import search as S
from quillstack.operators.vectors import neighbours, similarity_edges, vector_topk
from quillstack.plans.ingest import backfill, ingest, status_counts
from quillstack.plans.search import related, search
from quillstack.sources.library import Library, eval_cases, text_files

ROWS = [(1, "aaaa banana"), (2, "Banana bandana ana"), (3, None), (4, "x"), (5, "nothing at all"), (6, "a.b*c \\E d")]


def test_bm25_counts_overlaps(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    got = {r.id: r.score for r in S.bm25(df, ["ana"]).collect()}
    d = [max(len(t or "") - 2, 0) for _, t in ROWS]
    mean = sum(d) / len(d)
    f = {1: 2, 2: 4}
    idf = math.log((6 - 2 + 0.5) / 2.5)
    want = {i: round(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * d[i - 1] / mean)), 6) for i, n in f.items()}
    assert got == want
    assert {r.id for r in S.bm25(df, ["a.b*c \\e"]).collect()} == {6}


def test_fallbacks(spark):
    df = spark.createDataFrame(ROWS, "id long, text string")
    assert [r.id for r in S.terms_topk(df, "an").orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in S.phrase_topk(df, "not there").collect()] == []
    assert [r.id for r in S.terms_topk(df, "%").collect()] == []


def test_rrf_ignores_order_of_lists(spark):
    r = random.Random(1)
    lists = [spark.createDataFrame([(i, n + 1) for n, i in enumerate(r.sample(range(20), 10))], "id long, rank int") for _ in range(3)]
    one, two = ({x.id: x.score for x in S.rrf(ls).collect()} for ls in (lists, lists[::-1]))
    assert one == two and max(one.values()) <= round(3 / 61, 6)


def test_boost(spark):
    rows = [(1, 10 + i, 1.0) for i in range(9)] + [(2, 50, 1.4)]
    got = {r.paper_id: (r.chunk_id, r.score, r.matched) for r in S.aggregate_papers(spark.createDataFrame(rows, "paper_id long, id long, score double"), 5).collect()}
    assert got == {1: (10, 1.5, 9), 2: (50, 1.4, 1)}


def test_vectors(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(98, [0.0, 0.0]), (99, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vector_topk(df, [1.0, 0.0], 4).orderBy("rank").collect()
    want = sorted(((-round(math.cos(i), 5), i) for i in range(50)))[:4]
    assert [r.id for r in got] == [i for _, i in want]
    few, many = ({(r.a, r.b, r["rank"]) for r in neighbours(df, 3, block=b).collect()} for b in (7, 4096))
    assert few == many and len(many) == 51 * 3
    assert all(e.src < e.dst and e.weight >= 0.9 for e in similarity_edges(df, threshold=0.9).collect())


DOCS = {
    "attention.md": "Sparse Attention for Long Texts\n\nAda Lovelace, Alan Turing\n\nYear: 2021\nDOI: 10.1234/sparse\n\n# Abstract\nSparse attention lowers the cost of transformers on long sequences.\n\n# Method\nWe mask most of the attention matrix and keep local windows.",
    "crops.md": "Gene Editing in Crops\n\nGrace Hopper, Mary Shelley\n\nYear: 2015\n\n# Abstract\nGuide RNAs edit wheat against rust disease.\n\n# Results\nOff-target edits were rare in wheat lines.",
    "graphs.md": "Message Passing for Molecules\n\nYear: 2019\n\n# Abstract\nGraph networks predict molecular energy from atoms and bonds.\n\n# Method\nMessages pass along bonds; attention weights the neighbours.",
    "copy.md": "Gene Editing in Crops\n\nGrace Hopper, Mary Shelley\n\nYear: 2015\n\n# Abstract\nGuide RNAs edit wheat against rust disease.\n\n# Results\nOff-target edits were rare in wheat lines.",
}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    (folder / "sub").mkdir()
    for name, text in DOCS.items():
        (folder / "sub" / name).write_text(text)
    (folder / "bad.md").write_bytes(b"\xff\xfe\x00bad")
    lib, report = ingest(Library.empty(spark), text_files(spark, str(folder)), hooks.hashing_embedder(32), hooks.lead_summary)
    path = str(tmp_path_factory.mktemp("lib") / "one")
    lib.write(path)
    return Library.open(spark, path), {r.status: r.n for r in status_counts(report).collect()}


def test_ingest(spark, library):
    lib, counts = library
    assert counts == {"ok": 3, "duplicate": 1, "error": 1}
    got = {r.title: r for r in lib.papers.collect()}
    assert set(got) == {"Sparse Attention for Long Texts", "Gene Editing in Crops", "Message Passing for Molecules"}
    a = got["Sparse Attention for Long Texts"]
    assert (a.authors, a.year, a.doi) == ("Ada Lovelace; Alan Turing", 2021, "10.1234/sparse")
    assert lib.chunk_vectors.count() == lib.chunks.count() and lib.paper_vectors.count() == 3
    again, report = ingest(lib, spark.createDataFrame([("z", DOCS["crops.md"], "ok"), ("y", "# New\ntext", "ok")], "path string, text string, status string"))
    assert {r.path: r.status for r in report.collect()} == {"z": "duplicate", "y": "ok"}
    assert again.papers.agg(F.max("id")).first()[0] == 4 and again.chunk_vectors.count() == lib.chunk_vectors.count()
    assert backfill(again, hooks.hashing_embedder(32)).chunk_vectors.count() == again.chunks.count()


@pytest.mark.parametrize("query, filters, dim, want", [
    ("sparse attention", {}, 0, "Sparse Attention for Long Texts"),
    ("wheat rust", {}, 32, "Gene Editing in Crops"),
    ("bonds", {"year_min": 2018}, 0, "Message Passing for Molecules"),
    ("attention", {"author": "turing"}, 32, "Sparse Attention for Long Texts"),
])
def test_search_finds(spark, library, query, filters, dim, want):
    lib, _ = library
    cards = search(spark, lib, query, 2, hooks.hashing_embedder(dim) if dim else None, hooks.overlap_reranker, **filters)
    assert want in render.hits(cards)


def test_filters_without_matches(spark, library):
    assert search(spark, library[0], "attention", 3, year_min=2030).count() == 0


def test_related(spark, library):
    lib, _ = library
    ids = {r.title: r.id for r in lib.papers.collect()}
    a, g = ids["Sparse Attention for Long Texts"], ids["Message Passing for Molecules"]
    cites = spark.createDataFrame([(1, g, "refs", "doi:10.1234/SPARSE", "", 2021), (2, a, "refs", "x", "Message passing for molecules and more", None)], "cid long, paper_id long, direction string, ext_id string, title string, year int")
    lib2 = Library(**{**lib.__dict__, "citations": cites})
    assert [(r.relation, r.id) for r in related(lib2, g, None).collect()] == [("cites", a)]
    near = related(lib2, a, list(lib.paper_vectors.filter(F.col("id") == a).first().embedding), 2).filter("relation = 'semantic'").collect()
    assert len(near) == 2 and a not in {r.id for r in near}


def test_evaluation(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text('{"cases": [{"id": "a", "query": "q", "expect_any": ["X"], "filters": {"year_min": 2000}}, {"id": "b", "query": "r", "expect_all": ["X", "Y"]}]}')
    cases = {r.id: r for r in eval_cases(spark, str(path)).collect()}
    assert cases["a"].filters.year_min == 2000 and cases["b"].expect_all == ["X", "Y"]
    ranked = spark.createDataFrame([("a", 1, 2), ("b", 1, 1), ("c", 9, 1)], "case_id string, paper_id long, rank int")
    expected = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("b", 2, True), ("c", 3, False)], "case_id string, paper_id long, need_all boolean")
    judged = evaluate.judge(ranked, expected)
    assert {r.case_id: (r.passed, r.rr) for r in judged.collect()} == {"a": (True, 0.5), "b": (False, 1.0), "c": (False, 0.0)}
    s = evaluate.summary(judged).first()
    assert (s.cases, s.recall, s.mrr) == (3, 0.333333, 0.5) and not evaluate.gate(s.recall)
    t = evaluate.latency(spark.createDataFrame([(float(i),) for i in range(1, 101)], "seconds double")).first()
    assert (t["median"], t.p95) == (50.5, 95.0)
