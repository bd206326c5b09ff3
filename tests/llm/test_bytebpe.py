"""Byte-level BPE against the tiktoken library, its offsets against the tokenizers library, and exact round trips."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import bytebpe

from .helpers import awkward, frame

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
UNUSUAL = ["\U0003fc3b a", "x՘y", "\x1c\x1d a", "a\x85b\xa0c", "👩‍👩‍👧 👍🏽", "é é", "   \n\n  x  ", "aaa" * 500, "'s 'S 're’s", "٣٤ 12 ½", "한국어 テスト 你好", "the " * 50_000]


@pytest.fixture(scope="module")
def want():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bytebpe.ByteCodec(PATH, PATTERN)


def rows():
    return [*awkward(), *((1000 + i, t) for i, t in enumerate(UNUSUAL)), (7, "twice"), (7, "twice"), (None, "no id")]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_report(spark, want):
    got = sorted((tuple(r) for r in bytebpe.encode_report(frame(spark, rows()), PATH, PATTERN).drop("n_in_parts").collect()), key=repr)
    ids = [(i, t or "", want.encode_ordinary(t or "")) for i, t in rows()]
    assert got == sorted(((i, len(x), sha(",".join(map(str, x)).encode()), sha(t.encode())) for i, t, x in ids), key=repr)


def test_ids_offsets_and_back(spark, want, codec):
    encoded = bytebpe.encode_documents(frame(spark, rows()), PATH, PATTERN)
    texts = dict(rows()[:-3])
    for r in encoded.filter("doc_id <> 7").collect():
        text = texts[r["doc_id"]] or ""
        lib = codec.tok.encode(text, add_special_tokens=False)
        assert list(r["ids"]) == want.encode_ordinary(text) == lib.ids
        assert list(zip(r["starts"], r["ends"])) == lib.offsets
    back = bytebpe.decode_documents(encoded, PATH, PATTERN).collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") and r["bytes"] == r["text"].encode() for r in back if r["doc_id"] in texts)
    assert len(back) == len(rows())


def test_characters_in_parts(spark, codec):
    """Ids that end within a character decode to its bytes; the text marks them, and both parts cover the character."""
    text = "a 𠀀 b"
    (ids,) = codec.encode_all([text])
    starts, ends = codec.offsets(text, ids)
    parts = bytebpe.in_parts(starts, ends)
    assert parts.sum() >= 2 and {(s, e) for s, e, p in zip(starts.tolist(), ends.tolist(), parts) if p} <= {(2, 3), (1, 3)}
    k = int(np.flatnonzero(parts)[0]) + 1
    halves = spark.createDataFrame([(1, ids[:k].tolist()), (2, ids[k:].tolist()), (3, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r for r in bytebpe.decode_documents(halves, PATH, PATTERN).collect()}
    assert got[1]["bytes"] + got[2]["bytes"] == text.encode() and "�" in got[1]["text"] + got[2]["text"] and got[3]["text"] == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab e's1\n .é你👍́‍"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(want, codec, text):
    (ids,) = codec.encode_all([text])
    assert ids.tolist() == want.encode_ordinary(text) and codec.decode(ids.tolist()) == text.encode()
    assert list(zip(*(x.tolist() for x in codec.offsets(text, ids)))) == codec.tok.encode(text, add_special_tokens=False).offsets


def test_memo_is_bounded(want, codec, monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE", 20_000)
    for k in range(30):
        texts = [f"w{k * 100 + i} common word{i}" for i in range(100)]
        assert [x.tolist() for x in codec.encode_all(texts)] == [want.encode_ordinary(t) for t in texts]
    assert codec.held <= 20_000


def test_empty(spark):
    assert bytebpe.encode_report(frame(spark, []), PATH, PATTERN).collect() == []
    assert bytebpe.encode_documents(frame(spark, []), PATH, PATTERN).collect() == []


def test_every_code_point_is_classed_alike(codec):
    """Splitting outside the library gives the library's matches, but for characters that go to it whole."""
    from tokenizers import Regex, pre_tokenizers

    other = pre_tokenizers.Split(Regex(PATTERN), "isolated")
    for at in range(0, 0x30000, 64):
        text = "".join(f"a{c}b1{c}2 {c}{c} .{c}\n" for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000 and not codec._odd(c))
        assert codec.split.findall(text) == [m for m, _ in other.pre_tokenize_str(text)], hex(at)
