"""Searching with a table of queries equals searching with each; evaluation over real searches."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillstack import hooks
from quillstack.functions.scalars import strip_all
from quillstack.operators import evaluate
from quillstack.operators import search as S
from quillstack.plans import batch
from quillstack.plans import search as single

DATA = "/root/testdata/sf0.001"
EMBED = hooks.hashing_embedder(32)
CASES = ["thing", "heoron thing", "that and", "zz", "ein", "nowhere at all qq", "the thing, of heoron; the"]


@pytest.fixture(scope="module")
def lib(spark):
    from quillstack.plans import queries as Q

    p, c = Q.papers(spark, DATA).cache(), Q.chunks(spark, DATA).cache()
    texts = single.with_index_text(p)
    pv, cv = hooks.embed_rows(texts, EMBED, "id", "index_text").filter("id % 3 > 0").cache(), hooks.embed_rows(c, EMBED).cache()
    return SimpleNamespace(papers=p, chunks=c, paper_vectors=pv, chunk_vectors=cv)


def queries(spark, texts, vectors=True):
    rows = [(i, v, t, x if vectors else None) for i, group in enumerate(texts) for v, (t, x) in enumerate(zip(group, EMBED(group)))]
    return spark.createDataFrame(rows, "case long, v int, text string, vector array<double>").cache()


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["case"], []).append((r["rank"], r["paper_id"], r["chunk_id"], r["score"], r["matched"]))
    return {c: sorted(v) for c, v in out.items()}


def one(spark, lib, group, vectors, allowed, k=5):
    asked = [(t.strip(), x if vectors else None) for t, x in zip(group, EMBED(group))]
    p = single.with_index_text(lib.papers)
    found = single.two_stage(p, lib.chunks, lib.paper_vectors if vectors else None, lib.chunk_vectors if vectors else None, asked, k, allowed)
    if found.isEmpty():
        found = single.global_search(lib.chunks, lib.chunk_vectors if vectors else None, asked, max(2 * k, 8), allowed)
    rows = sorted(found.collect(), key=lambda r: (-r["score"], r["paper_id"]))[:k]
    return [(n + 1, r["paper_id"], r["chunk_id"], pytest.approx(r["score"], abs=2e-6), r["matched"]) for n, r in enumerate(rows)]


@pytest.mark.parametrize("vectors", [True, False])
def test_equals_single_searches(spark, lib, tmp_path, vectors):
    """Cases of one and two variants, with filters, without, and with filters that nothing passes."""
    groups = [[t] for t in CASES] + [["thing", "heoron"]]
    index = batch.SearchIndex.build(str(tmp_path / "ix"), lib.papers, lib.chunks, *((lib.paper_vectors, lib.chunk_vectors) if vectors else ()))
    filters = {1: dict(year_min=2010), 2: dict(venue="src1"), 4: dict(year_max=1900)}
    ids = {c: S.meta_filter(lib.papers, **f) for c, f in filters.items()}
    allowed = None
    for c, df in ids.items():
        rows = df.select(F.lit(10 * c).alias("filter"), "id")
        allowed = rows if allowed is None else allowed.union(rows)
    of_cases = spark.createDataFrame([(c, 10 * c) for c in filters], "case long, filter int")
    got = answers(batch.search_all(index, queries(spark, groups, vectors), 5, of_cases, allowed.cache()))
    for c, group in enumerate(groups):
        assert got.get(c, []) == one(spark, lib, group, vectors, ids.get(c)), group
    assert got[0] and not got.get(4)


def test_evaluation(spark, lib, tmp_path):
    """Cases judged over one batch of searches: titles to papers, ranks, recall and MRR."""
    index = batch.SearchIndex.build(str(tmp_path / "ix"), lib.papers, lib.chunks)
    some = lib.papers.filter("length(title) > 30").orderBy("id").limit(6).collect()
    texts = [" ".join(r["abstract"].split()[5:9]) for r in some]
    found = batch.search_all(index, queries(spark, [[t] for t in texts], False), 5)
    expected = spark.createDataFrame([(i, r["title"][:30].upper() if i else "no such title") for i, r in enumerate(some)], "case_id long, pattern string")
    refs = evaluate.resolve_titles(expected, lib.papers).withColumn("need_all", F.lit(False))
    judged = evaluate.judge(found.select(F.col("case").alias("case_id"), "paper_id", "rank"), refs)
    s = evaluate.summary(judged).first()
    assert s["cases"] == 5 and s["recall"] >= 0.8 and 0 < s["mrr"] <= 1


def test_strip_all(spark):
    assert spark.createDataFrame([(" 　\x1c a b \n",)], "t string").select(strip_all("t")).first()[0] == "a b"
