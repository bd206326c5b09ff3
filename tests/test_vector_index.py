"""The vector index against comparing all rows; what it reads on clustered vectors; joins that skip clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators.vector_index import VectorIndex

SCHEMA = "id long, embedding array<float>"


def clustered(n=3000, dim=16, groups=30, spread=0.05, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))
    return [(int(i) * 7, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def awkward():
    rows = clustered(300, spread=2.0)
    return [*rows, (5000, [0.0] * 16), (5001, [0.0] * 16), (5002, None), (5003, [1.0, 2.0]), (5004, rows[0][1]), (5005, [2 * v for v in rows[0][1]]), (5006, [-v for v in rows[0][1]])]


def sims(rows, q):
    x = np.array([v for _, v in rows if v is not None and len(v) == len(q)])
    ids = np.array([i for i, v in rows if v is not None and len(v) == len(q)])
    size = lambda m: np.where((s := np.sqrt((m * m).sum(-1))) == 0, 1.0, s)
    s = np.round((x @ np.array(q)) / size(x) / size(np.array(q)), 6) + 0.0
    return ids, s


def brute(rows, q, k):
    ids, s = sims(rows, q)
    order = np.lexsort((ids, -s))[:k]
    return [(int(ids[i]), pytest.approx(float(s[i]), abs=2e-6), n + 1) for n, i in enumerate(order)]


def got(result, q):
    return [(r["id"], r["sim"], r["rank"]) for r in sorted(result.filter(result.q == q).collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("rows, clusters, block", [(clustered(), None, 4096), (clustered(), 7, 50), (awkward(), 5, 40), (awkward(), 1, 4096)])
def test_topk_is_exact(spark, tmp_path, rows, clusters, block):
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "ix"), clusters=clusters, block=block, sample=500)
    assert index.n.sum() == sum(v is not None and len(v) == 16 for _, v in rows)
    asked = [(0, rows[0][1]), (1, rows[17][1]), (2, [0.0] * 16), (3, [1.0] * 16), (4, None), (5, [1.0])]
    result = index.topk(spark.createDataFrame(asked, "q long, vector array<float>"), k=12)
    for q, v in asked[:4]:
        assert got(result, q) == brute(rows, v, 12), q
    assert got(result, 4) == got(result, 5) == []
    everything = index.topk(spark.createDataFrame(asked[:1], "q long, vector array<float>"), k=10_000)
    assert everything.count() == index.n.sum()


def test_reads_few_clusters(spark, tmp_path):
    """On clustered vectors most clusters are proven away; a bound is never below what a cluster holds."""
    rows = clustered(6000, groups=60)
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "ix"), clusters=60)
    asked = spark.createDataFrame([(k, rows[k * 31][1]) for k in range(40)], "q long, vector array<float>")
    report = index.report(index.topk(asked, k=10)).collect()
    assert len(report) == 40 and sum(r["rows"] for r in report) < 0.2 * 40 * 6000 and all(r["of_rows"] == 6000 for r in report)
    held = {}
    for r in index.rows().collect():
        held.setdefault(r["cluster"], []).append((r["id"], r["v"]))
    bound = index.bounds(np.array([rows[3][1]]))[0]
    for c, top in zip(index.ids, bound):
        assert sims(held[c], rows[3][1])[1].max() <= top


@pytest.mark.parametrize("k", [None, 3])
def test_similar(spark, tmp_path, k):
    rows = clustered(400, groups=12, spread=0.4) + [(9000, [0.0] * 16), (9001, clustered(1)[0][1])]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "ix"), clusters=12, block=20)
    found = sorted((r["a"], r["b"]) for r in index.similar(0.9, k).collect())
    want = []
    for i, v in rows:
        ids, s = sims(rows, v)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i and s[j] >= 0.9]
        want += [(i, int(ids[j])) for j in order[:k]]
    assert found == sorted(want) and len(want) > 100
    assert len(index.meetings(0.9)) < len(index.ids) * (len(index.ids) + 1) // 2


def test_similar_by_tiles(spark, tmp_path, monkeypatch):
    """Rows are copied by tiles, not by pairs of blocks: to few tasks, whether or not clusters are far apart, with the same pairs."""
    from quillstack.operators import vector_index

    for tile, spread, least in ((60, 0.4, 0.9), (60, 3.0, 0.3), (4000, 3.0, 0.3)):
        monkeypatch.setattr(vector_index, "TILE", tile)
        rows = clustered(400, groups=12, spread=spread) + [(9000, [0.0] * 16), (9001, clustered(1)[0][1])]
        index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), str(tmp_path / f"ix{tile}{spread}"), clusters=40, block=20)
        met = np.zeros((len(index.ids), len(index.ids)), bool)
        met[tuple(index.meetings(least).T)] = True
        assert len(set(index.tiles(met | met.T)) - {-1}) <= 402 // tile + 1 < len(index.ids)
        want = set()
        for i, v in rows:
            ids, s = sims(rows, v)
            want |= {(i, int(ids[j])) for j in [j for j in np.lexsort((ids, -s)) if ids[j] != i and s[j] >= least][:3]}
        assert {(r["a"], r["b"]) for r in index.similar(least, 3).collect()} == want and len(want) > 100


def test_empty(spark, tmp_path):
    index = VectorIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "ix"))
    assert index.topk(spark.createDataFrame([(1, [1.0])], "q long, vector array<float>")).collect() == [] and index.similar(0.5).collect() == []


def test_best_pairs():
    """The few pairs multiplied in double are the same as by sorting all products, with ties and a bound."""
    from quillstack.operators.vectors import best_pairs, unit

    r = np.random.default_rng(5)
    for m, n, d, tied in ((70, 900, 3, True), (40, 2, 4, False), (600, 500, 16, False)):
        x, y = r.normal(size=(m, d)), r.normal(size=(n, d))
        x, y = (unit(v.round(0) if tied else v) for v in (x, y))
        ix, iy = r.permutation(2000)[:m], r.permutation(2000)[:n]
        s = np.round(x @ y.T, 6) + 0.0
        for k, least, same in ((1, None, True), (3, 0.35, True), (None, 0.35, False), (3, 0.35, False)):
            want = set()
            for i in range(m):
                j = [j for j in np.lexsort((iy, -s[i])) if (same or ix[i] != iy[j]) and (least is None or s[i, j] >= least)]
                want |= {(int(ix[i]), int(iy[j]), float(s[i, j])) for j in j[:k]}
            assert set(zip(*(c.tolist() for c in best_pairs(x, ix, y, iy, k, least, same)))) == want


def test_blocks_meet_once(spark, monkeypatch):
    """Each pair of blocks is one task's, for the rows of both; a bound leaves out lesser pairs."""
    from quillstack.operators.vectors import neighbours

    rows = spark.range(1, 601).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(8)]).alias("embedding"))
    got = {(r["a"], r["b"], r["rank"]) for r in neighbours(rows, 3, block=100).collect()}
    assert got == {(r["a"], r["b"], r["rank"]) for r in neighbours(rows, 3, block=1000).collect()} and len(got) == 1800
    assert {r["a"] for r in neighbours(rows, 3, block=100, least=0.999999).collect()} == {r[0] for r in got}
