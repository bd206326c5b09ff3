"""The pipeline's near-dedup and packing against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from quillstack.llm import nearcopies, simhash

from .helpers import DATA, awkward, frame
from .test_documents import brute_components


def grams(text):
    toks = (text or "").encode().lower().split()
    return {tuple(toks[i : i + 5]) for i in range(max(1, len(toks) - 4))} if toks else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited_copies(n=90, seed=4):
    """Copies with up to six words changed, whose fingerprints lie many bits apart, and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(200)], " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        own = list(base)
        for at in r.sample(range(200), r.randint(0, 6)):
            own[at] = word()
        rows.append((10 * i + 3, " ".join(own)))
        rows.append((10 * i + 5, passage + " " + " ".join(word() for _ in range(r.randint(10, 90)))))
    return rows + [(7000 + i, " ".join(base[:n])) for i, n in enumerate((120, 140, 160, 180, 199))]


@pytest.mark.parametrize("bucket", [2, 32])
def test_near_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(nearcopies, "BUCKET", bucket)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for rows in (awkward(), edited_copies(), docs, []):
        sets = {i: grams(t) for i, t in rows}
        ids = sorted(sets)
        want = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near(sets[a], sets[b])])
        kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), DATA).collect()
        assert sorted(r.doc_id for r in kept) == sorted(i for i in ids if want[i] == i)


def test_every_kept_document_is_packed(spark):
    rows = [(1, "one two three four five six"), (2, ""), (3, None), (4, "seven"), (5, " ")]
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["substring_dedup"](spark, frame(spark, rows), DATA)
    packed = stages["packing"](spark, docs, DATA)
    assert sorted(r.doc_id for r in packed.filter("piece = 0").collect()) == sorted(r.doc_id for r in docs.collect()) == [1, 2, 3, 4, 5]


def test_buckets_stream():
    """Runs that reach over batches come whole or, when they are long, in parts that overlap."""
    r = random.Random(8)
    rows = sorted((h, r.randint(0, 400)) for h in range(12) for _ in range(r.choice([1, 2, 5, 30, 40, 90])))

    def run(size, most=None):
        parts = (rows[i : i + size] for i in range(0, len(rows), size))
        return [list(zip(*(c.tolist() for c in cols))) for cols in nearcopies._buckets((pa.RecordBatch.from_arrays([pa.array([x[k] for x in p], pa.int64()) for k in range(2)], ["h", "v"]) for p in parts), 2, most)]

    for size in (1, 7, 50, 1000):
        assert [x for part in run(size) for x in part] == rows
        assert all(len({i for i, part in enumerate(run(size)) if any(x[0] == h for x in part)}) == 1 for h in range(12))
    for size in (1, 7, 50):
        seen, long = [], {}
        for part in run(size, 33):
            for h in {x[0] for x in part}:
                own = [x for x in part if x[0] == h]
                if h in long:
                    assert own[0] == long[h][0] and own[1] == long[h][1]
                    own = own[2:]
                seen += own
                if len(own) > 33 or h in long:
                    long[h] = (long[h][0] if h in long else own[0], own[-1] if own else long[h][1])
        assert sorted(seen) == rows


def test_rows_of_one_id(spark):
    """Copies go by row, not by id; rows of one id with different texts are different documents."""
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(1, a), (2, b), (2, a), (3, b + " more"), (None, a), (4, a.upper())]), DATA).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, a), (1, a), (2, b)]


def test_covering_masks_link(spark, monkeypatch):
    """Copies whose fingerprints lie within the radius are linked by the masks alone; those that are not similar stay."""
    monkeypatch.setattr(nearcopies, "_met", lambda batches: iter(()))
    r = random.Random(8)
    a = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(a), " ".join([*a[:-1], "other"]), " ".join(a[:1500])]
    x, y = (simhash.fingerprint(t, nearcopies.WORDS) for t in texts[:2])
    assert 0 < (x ^ y).bit_count() <= simhash.RADIUS
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, list(enumerate(texts))), DATA).collect()
    assert sorted(k.doc_id for k in kept) == [0, 2]


def proposed(sets, nearest=None):
    """Pairs across components of one bucket, each set a component of its own."""
    rows = sorted((len(s), i) for i, s in enumerate(sets))
    cols = [np.zeros(len(sets), np.int64), [n for n, _ in rows], np.zeros(len(sets), np.int64), [i for _, i in rows], [i for _, i in rows]]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([nearcopies.parities(sets[i]) for _, i in rows], pa.binary())], ["h", "n", "at", "rep", "component", "bits"])
    return [p for out in nearcopies._across(iter([batch]), nearest) for p in zip(*(c.to_pylist() for c in out.columns))]


def test_pairs_across_components_are_few():
    """Sets that share much but not enough make no pairs; similar ones make a few each in a round, and all of them at last."""
    r = np.random.default_rng(5)
    new = lambda n: r.integers(0, 2**63, n, dtype=np.uint64)
    common = new(140)
    assert proposed([np.unique(np.r_[common, new(60)]) for _ in range(300)]) == []
    alike = [np.unique(np.r_[common, new(4)]) for _ in range(100)]
    assert len(proposed(alike)) == 100 * 99 // 2
    few = proposed(alike, nearcopies.NEAREST)
    assert {i for p in few for i in p} == set(range(100)) and len(few) == len(set(few)) <= nearcopies.NEAREST * 100


def test_frequent_shingles_come_last(spark):
    """Frequent shingles have a level, unless more are frequent than the table takes; a prefix begins with the others."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(64)]
    docs = frame(spark, rows).select("doc_id", "text")
    table = nearcopies._levels(docs)
    s, common = nearcopies.shingles(rows[0][1]), nearcopies.shingles(passage)
    level = table[(common % np.uint64(len(table))).astype(np.int64)]
    assert set(level) == {6} and np.count_nonzero(table) == 26
    assert not np.intersect1d(nearcopies.prefix(s, table), common).size and np.intersect1d(nearcopies.prefix(s, np.zeros_like(table)), common).size
    assert not nearcopies._levels(docs, taken=25).any()
