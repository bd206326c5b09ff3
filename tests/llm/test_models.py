"""Vector search, toxicity and the pipeline."""

import math
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from quillstack.llm import topk, toxicity
from quillstack.llm.common import components

from .helpers import DATA, awkward, frame


def brute_top(vectors, k=5):
    v = {i: np.floor(256 * np.array(x)).astype(object) for i, x in vectors if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = set()
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)
            out |= {(q, r + 1, i, int(-x)) for r, (x, i) in enumerate(s[:k])}
    return out


def run_top(spark, vectors):
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in vectors], "vec_id long, embedding array<float>, block int, v int").repartition(3)
    q = topk.quantise(df)
    got = topk.search(topk.build_index(q, block_rows=100), q.filter("vec_id % 50 = 0"), query_rows=7)
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()}


def test_topk(spark):
    r = np.random.default_rng(0)
    base = [(i, [float(x) for x in r.normal(size=16).astype(np.float32)]) for i in range(600)]
    same = base[100][1]
    base = [(i, same if i % 3 == 0 else x) for i, x in base]
    assert run_top(spark, base) == brute_top(base)
    odd = [(0, [1.0, 2.0]), (50, []), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, -0.5]), (100, [0.0, 0.0])]
    assert run_top(spark, odd) == brute_top(odd)
    assert run_top(spark, []) == set()


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 150), (200, 151), (200, 152)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 150, 150: 150, 151: 150, 152: 150}


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    hit, miss = out[out["toxic"] == 1], out[out["toxic"] == 0]
    assert (hit["predicted"] == 1).mean() > 0.9 and (miss["predicted"] == 0).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_toxicity_awkward(spark):
    rows = awkward() + [(-1, "you idiot, you moron")]
    for labels in (spark.createDataFrame([(i, 1, k % 2 if k % 5 else None) for k, (i, _) in enumerate(rows)], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "doc_id long, quality int, toxic int")):
        model = toxicity.fit(frame(spark, rows), labels)
        got = toxicity.score_documents(frame(spark, rows), model).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got}[-1] == 1
    assert toxicity.score_documents(frame(spark, []), model).count() == 0


def test_label_model_tells_good_voters():
    r = np.random.default_rng(1)
    y = r.random(2000) < 0.2
    votes = np.stack([np.where(y, r.random(2000) < 0.8, r.random(2000) < 0.02) for _ in range(4)] + [r.random(2000) < 0.3], axis=1)
    votes = np.c_[votes, votes[:, 0]]  # an echo
    given = (y ^ (r.random(2000) < 0.04)).astype(int)
    p, accuracy, voice = toxicity.label_model(votes, 0.2, given)
    assert ((p > 0.5) == y).mean() > 0.94
    assert accuracy[:4].min() > 0.7 and accuracy[4] < 0.4
    assert voice[0] < voice[1] <= voice[4]  # an echoed voter speaks with half a voice


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.count() <= docs.count()
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert got["doc_id"].nunique() > 100
    odd = frame(spark, awkward())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, odd, DATA).count() > 0


def test_queries_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} >= set(range(1, 11))


def test_voters_for_clean_texts():
    """Voters for clean texts count against, and accuracies come out right for voters of either kind."""
    r = np.random.default_rng(4)
    y = r.random(3000) < 0.3
    says = lambda hit, reach: np.where(r.random(3000) < reach, np.where(r.random(3000) < hit, np.where(y, 1, -1), np.where(y, -1, 1)), 0)
    votes = np.stack([says(0.9, 0.7), says(0.85, 0.7), says(0.6, 0.7), says(0.5, 0.5), says(0.8, 0.7)], axis=1)
    given = (y ^ (r.random(3000) < 0.1)).astype(int)
    p, accuracy, _ = toxicity.label_model(votes, 0.3, given)
    assert ((p > 0.5) == y).mean() > 0.95 > (given == y).mean()
    assert np.abs(accuracy - [0.9, 0.85, 0.6, 0.5, 0.8]).max() < 0.05
    only = -(votes == -1).astype(int)
    p, accuracy, _ = toxicity.label_model(only, 0.3, given)
    assert accuracy[0] > accuracy[4] > accuracy[2] > accuracy[3] and p[only[:, 0] == -1].mean() < p[only[:, 0] == 0].mean()


def test_patterns():
    hit = lambda t: {n for n in toxicity.features(t) if n.startswith("~")}
    assert hit("you are such an idiot") == {"~addressed"} and hit("i.d.i.o.t") == {"~apart"} and hit("what an 1d1ot") == {"~disguised"}
    assert hit("SCUM of the earth") == {"~shouted"} and hit("moron says moron") == {"~again"}
    assert hit("the trash was emptied") == hit("") == hit(None) == set()


def test_training_rows_are_bounded(spark):
    """One text of each id is fitted on, so that max_train bounds what comes to the driver."""
    rows = [(1, f"common words and number {i}") for i in range(300)] + [(i, "you idiot you moron, common words" if i % 2 else "fine weather and common words") for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.label_model
    try:
        toxicity.label_model = lambda votes, *a, **k: (seen.append(len(votes)), fit(votes, *a, **k))[1]
        toxicity.fit(frame(spark, rows), labels, max_train=20)
    finally:
        toxicity.label_model = fit
    assert seen and seen[0] <= 20


def test_topk_skips_by_proof(spark):
    """On vectors in clusters most blocks are skipped, and of the segments of those read some stay unread."""
    r = np.random.default_rng(3)
    middles = r.normal(size=(8, 16)) * 3
    rows = [(i, [float(x) for x in (middles[i % 8] + r.normal(size=16) * 0.2).astype(np.float32)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.quantise(df)
    index = topk.build_index(q, block_rows=200)
    asked = q.filter("vec_id % 50 = 0")
    assert {tuple(x) for x in topk.search(index, asked).collect()} == brute_top(rows)
    got = topk.search(index, asked, report=True).toPandas().sum()
    assert got["skipped"] > 0.5 * got["queries"] and got["read"] < got["segments"] or got["skipped"] == got["queries"]
    assert sum(len(np.frombuffer(x.ids, np.int64)) for x in index.blocks.select("ids").collect()) == 1600


@pytest.mark.parametrize("size", [3e5, 1e12, 1e15])
def test_topk_of_large_components(spark, size):
    """Scores that doubles do not hold are whole numbers all the same."""
    r = np.random.default_rng(11)
    rows = [(i, [float(x) for x in np.round(r.uniform(-size, size, 24))]) for i in range(200)]
    rows += [(500 + i, rows[i][1]) for i in range(5)]
    q = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(x) for x in topk.search(topk.build_index(q, block_rows=60), q.filter("vec_id % 50 = 0")).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    most = 2**63 - 1
    want = set()
    for i, v in whole.items():
        if i % 50 == 0:
            scores = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(v, w)))), j) for j, w in whole.items() if j != i)[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    if size < 1e12:
        assert got == want
    else:
        assert {(i, n, s) for i, n, _, s in got} == {(i, n, s) for i, n, _, s in want}


def test_topk_takes_every_finite_component(spark):
    rows = [(0, [1.0]), (1, [1e301]), (2, [float("inf")]), (3, [float("nan")]), (4, [None]), (5, None)]
    assert sorted(r["vec_id"] for r in topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == [0, 1]
