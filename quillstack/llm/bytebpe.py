"""Byte-level BPE with the tokenizers library over Arrow batches: ids, character offsets, and back to bytes.

A rank file lists byte strings by the rank at which merging makes them. The library wants strings and pairs, so each byte stands as
a printable character (the byte table below), and each way of splitting a listed string into two listed ones becomes a merge. Text
is split by the pattern first; each match is merged by itself, so the ids of matches are kept and joined, and only matches not yet
met go to the library. Offsets follow from the tokens' bytes and the text's: tokens that hold parts of one character all cover it.
Decoding turns each token's characters back into bytes; where ids end within a character, the text has U+FFFD for its bytes.

Defined results: null text is empty and has no ids; repeated rows are encoded apart; null and repeated document ids are kept; an empty table
gives no rows; other columns are not read. Texts may be of any length: one is held by a task at a time besides the others of its slice.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices

#: Bytes that a task keeps for matches and their ids, about; bounds memory only.
CACHE = 64 << 20
#: Characters of new matches that one call of the library takes, about.
CALL = 1 << 16


@functools.cache
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return tuple(chr(b if b in shown else next(spare)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merges_of(ranks: dict[bytes, int]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs whose joining gives a listed string, by its rank. Two ways to make one string can overlap in a text only
    where the right part of one is the left part of the other; the one that stands further left there goes first."""
    for token in sorted(ranks, key=ranks.__getitem__):
        ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        lefts = {left for left, _ in ways}
        yield from sorted(ways, key=lambda way: way[1] not in lefts)


class ByteCodec:
    """ids and character offsets of texts, and bytes of ids, by a rank file and a pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, table = read_ranks(path), byte_table()
        self.shown = str.maketrans({chr(b): c for b, c in enumerate(table)})
        model = models.BPE(vocab={self.name(t): r for t, r in ranks.items()}, merges=[(self.name(a), self.name(b)) for a, b in merges_of(ranks)], ignore_merges=True)
        self.tok, self.lines = Tokenizer(model), Tokenizer(model)
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.lines.pre_tokenizer = pre_tokenizers.Split("\n", "removed")  # no byte stands as a line end
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for i in ranks.values():
            self.bytes_of[i] = bytes(map(back.__getitem__, self.tok.id_to_token(i)))
        self.n_bytes = np.array([len(t or b"") for t in self.bytes_of], np.int64)
        self.split = regex.compile(pattern)
        self.usual: set[str] = set()
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def name(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.shown)

    def _odd(self, text: str) -> bool:
        """Whether it has characters without a class in this Python's tables: splitters of other versions may class them."""
        new = set(text).difference(self.usual)
        self.usual.update(c for c in new if unicodedata.category(c) != "Cn")
        return bool(new.difference(self.usual))

    def _learn(self, matches: list[str]) -> dict[str, bytes]:
        """Keep the ids of matches; those of unusual length are given back instead."""
        long: dict[str, bytes] = {}
        chars = itertools.accumulate(map(len, matches))
        for _, part in itertools.groupby(zip(matches, chars), key=lambda x: x[1] // CALL):
            part = [m for m, _ in part]
            shown = [self.name(m.encode()) for m in part]
            ids = np.array(self.lines.encode_batch_fast(["\n".join(shown)], add_special_tokens=False)[0].ids, np.int32)
            ends = 4 * np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, shown)))) + 4  # tokens cover the matches' bytes
            flat, i = ids.tobytes(), 0
            for m, j in zip(part, ends.tolist()):
                (self.memo if len(m) < 64 else long)[m] = flat[i:j]
                self.held += 230 + j - i if len(m) < 64 else 0  # the two objects and their place in the table
                i = j
        return long

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts together, so that their new matches go to the library together."""
        memo = self.memo
        parts = [None if not t.isascii() and self._odd(t) else self.split.findall(t) for t in texts]
        new = {m for p in parts if p for m in p if m not in memo}
        long = self._learn(sorted(new)) if new else {}
        out = []
        for t, p in zip(texts, parts):
            if p is None:
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32))
            else:
                out.append(np.frombuffer(b"".join([memo[m] if m in memo else long[m] for m in p] if long else map(memo.__getitem__, p)), np.int32))
        while self.held > CACHE:  # matches met early are the frequent ones
            self.memo = dict(itertools.islice(memo.items(), len(memo) // 3))
            self.held //= 3
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters [start, end) that each token lies in."""
        begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80, dtype=np.int32)  # characters up to each byte
        ends = np.cumsum(self.n_bytes[ids])
        return begun[ends - self.n_bytes[ids]] - 1, begun[ends - 1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def in_parts(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens hold only part of a character: those that share one with the token before or after."""
    shared = starts[1:] < ends[:-1]
    return np.concatenate([[False], shared])[: len(starts)] | np.concatenate([shared, [False]])[: len(starts)]


def _rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, one row at least."""
    for b in slices(batches):
        size = np.cumsum(np.array(b.column(1).cast(pa.large_binary()).to_pandas().map(lambda x: len(x or b"")), np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends): a document's ids and the characters [start, end) that each token lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(path, pattern)
        for b in _rows(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = codec.encode_all(texts)
            at = [codec.offsets(t, i) for t, i in zip(texts, ids)]
            cuts = pa.array(np.concatenate([[0], np.cumsum(list(map(len, ids)))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, [s for s, _ in at], [e for _, e in at])], ["doc_id", "ids", "starts", "ends"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes, text): what a list of ids stands for. A null list is empty; ids that the file does not list are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(path, pattern)
        for b in slices(batches, 64):
            raw = [codec.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(ids_col)).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary, text string")


def encode_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A document's number of tokens, how many of them hold only part of a character, and digests of its ids and of what they
    decode to: both directions in one pass, so that no ids travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteCodec(path, pattern)
        decimal = list(map(str, range(len(codec.bytes_of))))
        for b in _rows(batches):
            cols = [[], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for text, tokens in zip(texts, codec.encode_all(texts)):
                ids = tokens.tolist()
                row = len(ids), int(in_parts(*codec.offsets(text, tokens)).sum()), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "n_in_parts", "ids_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_in_parts long, ids_sha256 string, decoded_sha256 string")
