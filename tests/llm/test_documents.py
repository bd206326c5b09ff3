"""Operators on documents against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from quillstack.llm import fingerprints, hilbert, licenses, linefreq, packing, pieces, simhash, substrings

from .helpers import DATA, awkward, frame


def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    return [awkward(), docs, []]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_fingerprints(spark):
    for rows in tables(spark):
        got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprint_with_edits(frame(spark, rows)))}
        order = sorted(rows)
        assert len(got) == len(rows)
        for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
            t, nxt, r = t or "", nxt or "", got[i]
            q = len(t) // 4
            edited = t[: len(t) - q] + nxt[:q]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r["fingerprint"] == fingerprints.sketch(fingerprints.syncmers(t)[1]).hex()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if edited == t:
                assert r["near_edited"] == 1
            if t == nxt:
                assert r["near_next"] == 1


def test_syncmers_by_definition():
    k, s = fingerprints.K, fingerprints.S
    text = "the quick brown fox jumps over the lazy dog, twice over: the quick brown fox"
    at, h = fingerprints.syncmers(text)
    value = {text[i : i + s]: None for i in range(len(text) - s + 1)}
    codes = {u: fingerprints.syncmers(u + "\0" * 0)[1][0] for u in value}  # only to have distinct keys
    assert len(codes) == len(value)
    twice = text[:30] + "##" + text[:30]
    a, _ = fingerprints.syncmers(twice)
    first, second = {p for p in a if p + k <= 30}, {p - 32 for p in a if p >= 32}
    assert first == second and first  # context-free
    assert 0 < len(at) < len(text)


def test_anchor_rows(spark):
    got = fingerprints.anchors(frame(spark, [(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, None)])).collect()
    assert {r.doc_id for r in got} == {1} and all(0 <= r.position <= 78 - 16 for r in got)


def test_short_texts_have_features(spark):
    """Texts of 16 to 25 characters need not hold a closed syncmer; they differ from each other and from empty ones."""
    r = np.random.default_rng(11)
    texts = ["".join(r.choice(list("abcdefgh "), n)) for n in range(15, 27) for _ in range(40)]
    prints = {t: fingerprints.sketch(fingerprints.syncmers(t)[1]) for t in texts}
    assert b"\xff" * 128 not in prints.values()
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(2 * i + 1, "") for i in range(len(texts))]
    got = rows_of(fingerprints.fingerprint_with_edits(frame(spark, rows)))
    assert all(x["near_next"] < 1 for x in got)
    assert {x.doc_id for x in fingerprints.anchors(frame(spark, rows)).collect()} == {i for i, t in rows if t}


def brute_simhash(text):
    toks = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(toks[i : i + 3]) for i in range(max(1, len(toks) - 2))] if toks else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    for rows in tables(spark):
        fp = {i: brute_simhash(t) for i, t in rows}
        ids = sorted(fp)
        want = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3])
        got = rows_of(simhash.near_duplicates(frame(spark, rows)))
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in ids} and len(got) == len(rows)


def test_covering_masks():
    r = np.random.default_rng(5)
    for level in range(3):
        masks = simhash.covering_masks(3, level)
        for _ in range(500):
            d = sum(1 << int(i) for i in r.choice(64, 3, replace=False))
            assert any(not m & d for m in masks)


@pytest.mark.parametrize("bucket", [2, 512])
def test_dense_buckets(spark, bucket):
    """A cluster of many near fingerprints, with buckets split at every level."""
    r = np.random.default_rng(3)
    base = int(r.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in r.choice(20, int(r.integers(0, 7)))) for _ in range(150)} | {int(x) for x in r.integers(-(2**62), 2**62, 30)})
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(simhash._signed(f % 2**64), i) for i, f in rows], "fp long, rep long")
    edges = [(x.a, x.b) for x in simhash.links(df, bucket=bucket).collect()]
    want = brute_components(range(len(rows)), [(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) % 2**64).bit_count() <= 3])
    assert brute_components(range(len(rows)), edges) == want


def test_hilbert_walk():
    """Neighbours on the curve differ by one in one coordinate, and the curve visits every cell once."""
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        place, follow = hilbert._walk(n)
        where = {}
        for cell in range(1 << n * bits):
            xs = [cell >> bits * i & (1 << bits) - 1 for i in range(n)]
            h = s = 0
            for b in reversed(range(bits)):
                at = s * (1 << n) + sum((x >> b & 1) << i for i, x in enumerate(xs))
                h, s = h << n | place[at], follow[at]
            where[h] = xs
        assert sorted(where) == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(where[h], where[h + 1])) == 1 for h in range(len(where) - 1))


def test_hilbert_shards(spark):
    for rows in tables(spark):
        got = rows_of(hilbert.curve_shards(frame(spark, rows)))
        text = dict(rows)
        assert sorted(r["doc_id"] for r in got) == sorted(text)
        by = defaultdict(list)
        for r in got:
            data = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
            by[r["shard"]].append(r)
        if rows:
            sizes = [len(by[s]) for s in range(8)]
            assert max(sizes) - min(sizes) <= 1
        for s, own in by.items():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        flat = sorted(got, key=lambda r: (r["shard"], r["slot"]))
        assert [r["curve"] for r in flat] == sorted(r["curve"] for r in flat)


def best_score(codec, text):
    """Plain dynamic programming over all substrings."""
    t = "▁" + text.replace("▁", "\0").replace(" ", "▁") if text else ""
    best = [0.0] + [float("-inf")] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - 40), e):
            if codec.auto.exists(t[s:e]):
                best[e] = max(best[e], best[s] + codec.auto.get(t[s:e])[1])
        if t[e - 1] not in codec.singles:
            best[e] = max(best[e], best[e - 1] + codec.unknown)
    return best[len(t)]


def test_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = pieces.codec(path)
    rows = [(i, t if not t or len(t) < 3000 else t[:3000]) for i, t in awkward()]
    got = {r["doc_id"]: r for r in rows_of(pieces.encode_documents(frame(spark, rows), path))}
    back = {r["doc_id"]: r["text"] for r in rows_of(pieces.decode_documents(pieces.encode_documents(frame(spark, rows), path), path))}
    report = {r["doc_id"]: r for r in rows_of(pieces.encode_report(frame(spark, rows), path))}
    for i, t in rows:
        t = t or ""
        assert back[i] == t and report[i]["round_trip"]
        assert got[i]["score"] == pytest.approx(best_score(codec, t), abs=0.5, rel=1e-12)
        assert report[i]["n_tokens"] == len(got[i]["ids"]) and report[i]["ids_crc32"] == zlib.crc32(np.array(got[i]["ids"], "<u4").tobytes())


def test_lines(spark):
    lines = ["  nav bar\t", "nav bar", "", "unique %d"]
    rows = [(i, "\n".join([lines[i % 2], f"unique {i}", "", f"pair {i // 2}"])) for i in range(16)] + [(90, None), (91, "")]
    df = frame(spark, rows)
    src = {r.doc_id: r.source for r in df.collect()}
    got = {r["doc_id"]: r for r in rows_of(linefreq.drop_lines(df, ratio=0.6, min_pages=4))}
    pages, seen = Counter(src.values()), defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\r"):
                seen[src[i], x.strip(" \t\r")].add(i)
    for i, t in rows:
        if t is None:
            assert got[i]["_kept"] is None and got[i]["_n_lines"] == 0
            continue
        drop = lambda x: len(seen[src[i], x.strip(" \t\r")]) >= 4 and len(seen[src[i], x.strip(" \t\r")]) / pages[src[i]] > 0.6
        assert got[i]["_kept"] == "\n".join(x for x in t.split("\n") if not drop(x))
        assert got[i]["_n_dropped"] == sum(drop(x) for x in t.split("\n"))
        assert i >= 90 or "nav" not in got[i]["_kept"]


def brute_removed(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data, gone = (t or "").encode(), np.zeros(len((t or "").encode()), bool)
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("batch", [40, 16384])
def test_substrings(spark, batch):
    for rows in tables(spark):
        want = brute_removed(rows, 100)
        got = rows_of(substrings.remove_repeats(frame(spark, rows), batch=batch))
        assert len(got) == len(rows)
        for r in got:
            data = (dict(rows)[r["doc_id"]] or "").encode()
            gone = np.zeros(len(data), bool)
            for x in r["spans"]:
                gone[x["s"] : x["e"]] = True
            assert (gone == want[r["doc_id"]]).all(), r["doc_id"]
            kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
            assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and r["n_bytes"] == len(data)
            assert all(a["e"] < b["s"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_recurring_anchors(spark, monkeypatch):
    """Anchors travel as lists by part of their hashes, not as rows; those of two places are found, a text's copies under its least id."""
    import random

    monkeypatch.setattr(substrings, "PART", 200)
    r = random.Random(9)
    text = lambda n: "".join(r.choices("abcdef ", k=n))
    common, own = text(400), [text(900) for _ in range(12)]
    docs = [(i, t + common * (i % 3 == 0)) for i, t in enumerate(own)] + [(None, own[1]), (50, own[1]), (-4, own[2]), (51, own[5] * 2), (52, "short")]
    long = substrings._texts(frame(spark, docs), "doc_id", "text").filter("n >= 100")
    lists = substrings._anchor_lists(long, 100, 16, np.empty(0, np.uint64), 3).selectExpr("size(h) as n").collect()
    assert len(lists) <= 3 * 8 * 4 and sum(x["n"] for x in lists) > 200
    places, least, known = defaultdict(set), {}, set()
    for i, t in docs:
        x, h, _, _ = substrings.anchors_of(t.encode(), 100, 16)
        least[t] = min(least.get(t, (True, 10**9)), (i is not None, i or 0))
        for xx, hh in sorted(zip(x.tolist(), h.tolist())):
            if (t, hh) not in known:
                known.add((t, hh))
                places[hh].add((t, xx))
    want = {(least[t][1] if least[t][0] else None, x) for p in places.values() if len(p) > 1 for t, x in p}
    got = {(row["doc_id"], x) for row in substrings._recurring(long, 100, 16, np.empty(0, np.uint64)).collect() for x in row["places"] if x >= 0}
    assert got == want and len({i for i, _ in got}) > 4


def test_substrings_repeated_rows(spark):
    t = "abcdefghij" * 3 + "klmnopqrstuvwxyz" * 8 + "0123456789" * 7
    got = rows_of(substrings.remove_repeats(frame(spark, [(5, t), (5, t), (7, "x" + t)])))
    assert got[0]["doc_id"] in (5, 7) and len({r["kept_sha256"] for r in got if r["doc_id"] == 5}) == 1
    assert [r for r in got if r["doc_id"] == 7][0]["text"] == "x"


def test_licenses(spark):
    grant = licenses.TEMPLATES["mit"].split()
    edited = " ".join(grant[:8] + ["really"] + grant[8:20] + grant[21:])
    rows = awkward() + [(9001, "foo " + licenses.TEMPLATES["gpl-3"].upper() + " bar"), (9002, "x " * 40 + edited), (9003, "permission is hereby granted free of charge")]
    got = {r["doc_id"]: r for r in rows_of(licenses.scan(frame(spark, rows)))}
    assert len(got) == len(rows)
    for i, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        at = [(p, label) for label, ph in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert {x for _, x in at} <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert got[9001]["labels"] == "gpl-3" and got[9001]["score"] == 1
    assert got[9002]["labels"] == "mit" and 0.6 <= got[9002]["score"] < 1
    assert got[9003]["labels"] == "" and 0 < got[9003]["score"] < 0.6
    assert licenses.scan(frame(spark, [])).count() == 0


def test_packing_plan():
    r = np.random.default_rng(2)
    for trial in range(40):
        cap = int(r.choice([10, 30, 4096]))
        counts = {int(n): int(c) for n, c in zip(r.integers(1, cap + 1, 12), r.integers(1, 9, 12))}
        plan = packing.plan_packing(counts, cap)
        room = defaultdict(list)
        seen = Counter()
        for p in plan.places:
            for k in range(p.bins * p.per_bin):
                b, s = divmod(k, p.per_bin)
                room[p.sequence + b].append((p.offset + s * p.length, p.length))
                seen[p.length] += 1
        assert seen == Counter(counts) and sorted(room) == list(range(plan.sequences))
        for own in room.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= cap
        items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        bins = []
        for n in items:
            fit = [b for b in bins if b + n <= cap]
            if fit:
                bins[bins.index(max(fit))] += n
            else:
                bins.append(n)
        assert -(-sum(items) // cap) <= plan.sequences <= len(bins)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = packing.encoder(path).tok
    for rows in tables(spark):
        got = rows_of(packing.pack_documents(frame(spark, rows), path))
        by, seq = defaultdict(list), defaultdict(list)
        for r in got:
            by[r["doc_id"]].append(r)
            seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(by) == sorted(i for i, _ in rows)
        for i, t in rows:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            own = sorted(by[i], key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
            for r in own:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and (r["length"] == 4096 or r["piece"] == len(own) - 1)
        for own in seq.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 4096


def test_anchors_by_definition():
    """Anchors are the places of least hash of some string, with all strings in which they are it."""
    r = np.random.default_rng(1)
    for t in range(120):
        kind = ["few", "many", "again"][t % 3]
        n = int(r.integers(0, 400))
        data = bytes(r.choice([97, 98], n).astype(np.uint8)) if kind == "few" else r.bytes(n) if kind == "many" else (b"Is onhe. " * 50)[:n]
        length, k = (100, 16) if t % 2 else (30, 8)
        x, h, lo, hi = substrings.anchors_of(data, length, k)
        every, want = substrings._hashes(data, k).tolist() if n >= length else [], defaultdict(set)
        for p in range(n - length + 1):
            low = min(every[p : p + length - k + 1])
            for o in range(length - k + 1):
                if every[p + o] == low:
                    want[p + o].add(o)
        assert x.tolist() == sorted(want) and h.tolist() == [every[p] for p in sorted(want)]
        for p, a, z in zip(x.tolist(), lo.tolist(), hi.tolist()):
            assert want[p] <= set(range(a, z + 1)) and (kind != "many" or len(want[p]) == z + 1 - a)


@pytest.mark.parametrize("frequent, held", [(2, 50_000), (10**9, 5)])
def test_shared_passage(spark, monkeypatch, frequent, held):
    """A passage that stands in every document, at all distances from others, copies of them, and a passage said again and
    again in one, whether its anchors are known as frequent or not."""
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "HELD", held)
    r = np.random.default_rng(7)
    word = lambda n: "".join(r.choice(list("abcdefghij klmnop\x00"), n))
    passage, line = word(260), "Is onhe. "
    rows = [(i, word(int(r.integers(0, 200))) + passage[: int(r.integers(90, 261))] + word(int(r.integers(0, 150)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200, line * 90), (201, "x" + line * 40 + passage)]
    want = brute_removed(rows, 100)
    got = rows_of(substrings.remove_repeats(frame(spark, rows), batch=50))
    for x in got:
        gone = np.zeros(len(dict(rows)[x["doc_id"]].encode()), bool)
        for s in x["spans"]:
            gone[s["s"] : s["e"]] = True
        assert (gone == want[x["doc_id"]]).all(), x["doc_id"]
    assert len(got) == len(rows)


def plain_hash(codes):
    """The 64-bit hash of a run of code points, in whole numbers."""
    top, h = 1 << 64, 0
    for i, c in enumerate(codes):
        h = c if i == 0 else (h * 0x2545F4914F6CDD1D + c) % top
    h = (h ^ h >> 31) * 0x9FB21C651E98DF25 % top
    h = (h ^ h >> 29) * 0xD6E8FEB86659FD93 % top
    return h ^ h >> 32


def test_closed_syncmers_one_by_one():
    """A k-mer is chosen when the least hash of its s-mers stands first or last, judged k-mer by k-mer."""
    r = np.random.default_rng(6)
    k, s = fingerprints.K, fingerprints.S
    for _ in range(30):
        text = "".join(r.choice(list("abcdef é你\U0001f600"), int(r.integers(26, 160))))
        codes = [ord(c) for c in text]
        want = []
        for p in range(len(codes) - k + 1):
            inner = [plain_hash(codes[p + i : p + i + s]) for i in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append((p, plain_hash(codes[p : p + k])))
        at, h = fingerprints.syncmers(text)
        assert list(zip(at.tolist(), h.tolist())) == want


def test_likeness_follows_overlap():
    """The sketch's likeness lies near the share of common anchors that sets of them give."""
    r = np.random.default_rng(12)
    word = lambda: "".join(r.choice(list("abcdefghijkl"), int(r.integers(2, 9))))
    off = []
    for keep in (0.0, 0.3, 0.5, 0.8, 0.95, 1.0):
        for _ in range(6):
            a = [word() for _ in range(400)]
            cut = int(400 * keep)
            b = a[:cut] + [word() for _ in range(400 - cut)]
            x, y = (set(fingerprints.syncmers(" ".join(t))[1].tolist()) for t in (a, b))
            true = len(x & y) / len(x | y)
            got = fingerprints.likeness(*(fingerprints.sketch(np.array(sorted(z), np.uint64)) for z in (x, y)))
            assert abs(got - true) < 0.2
            off.append(got - true)
    assert abs(np.mean(off)) < 0.03
