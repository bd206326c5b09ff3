"""Packing token pieces into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is its histogram: a few thousand counts however
many documents there are. The driver plans on counts alone, in groups of equal sequences; each piece then finds
its place from its rank among the pieces of its length. Reduction fixes sets that dominate every alternative:
a full piece; a piece nothing fits beside; two pieces filling a sequence exactly; a piece beside which one other
fits at most, with the largest that does. What remains goes by decreasing length to the fullest sequence with room.

Defined results: null text is empty, and an empty text is its end token alone; repeated rows are packed apart; a null id is
kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import bisect
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted, slices

CAPACITY, END = 4096, 1
#: Bytes of words and ids that a task keeps, about; bounds memory only.
CACHE = 64 << 20


@dataclass
class Place:
    """Pieces of one length, from one rank on: per_bin in each of bins sequences, from an offset on."""

    length: int
    rank: int
    bins: int
    per_bin: int
    sequence: int
    offset: int


@dataclass
class Plan:
    capacity: int
    places: list[Place] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0
    ranks: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, bins: int, per_bin: int, sequence: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.places.append(Place(length, rank, bins, per_bin, sequence, offset))
        self.ranks[length] = rank + bins * per_bin

    def fix(self, bins: int, *lengths: int) -> None:
        offset = 0
        for n in lengths:
            self.put(n, bins, 1, self.sequences, offset)
            offset += n
        self.sequences += bins
        self.reduced += bins


def reduce_instance(plan: Plan, counts: dict[int, int]) -> None:
    """Fix dominating sets until none is left; counts keeps the remainder."""

    def take(bins: int, *lengths: int) -> None:
        plan.fix(bins, *lengths)
        for n in lengths:
            counts[n] -= bins
            if not counts[n]:
                del counts[n]

    changed = True
    while changed and counts:
        changed = False
        for n in sorted(counts, reverse=True):
            m = plan.capacity - n
            if n in counts and m == 0:
                take(counts[n], n)
                changed = True
            elif n in counts and n >= m and m in counts and (bins := counts[n] // 2 if n == m else min(counts[n], counts[m])):
                take(bins, n, m)
                changed = True
        while counts:
            sizes = sorted(counts)
            n = sizes[-1]
            room = plan.capacity - n
            lowest = sizes[0]
            second = lowest if counts[lowest] > 1 else sizes[1] if len(sizes) > 1 else plan.capacity
            at = bisect.bisect_right(sizes, room)
            if n <= room:
                if sum(counts.values()) > 1:
                    break
                at = 0
            if not at:
                take(counts[n], n)
            elif lowest + second > room:
                take(min(counts[n], counts[sizes[at - 1]]), n, sizes[at - 1])
            else:
                break
            changed = True


def best_fit(plan: Plan, counts: dict[int, int]) -> None:
    """Best-fit decreasing over groups (first sequence, how many) of equal room."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def add(room: int, group: tuple[int, int]) -> None:
        if room:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append(group)

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                room = order[at]
                first, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, first = plan.capacity, plan.sequences
                bins = -(-left // (room // n))
                plan.sequences += bins
            each, used = room // n, plan.capacity - room
            full = min(bins, left // each)
            if full:
                plan.put(n, full, each, first, used)
                add(room - each * n, (first, full))
                left -= full * each
            rest = bins - full
            if rest and left and left < each:
                plan.put(n, 1, left, first + full, used)
                add(room - left * n, (first + full, 1))
                left, full, rest = 0, full + 1, rest - 1
            if rest:
                add(room, (first + full, rest))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Reduction, then best fit. Fixing dominating sets loses no optimum, but best fit may by chance do better on the
    whole than on what they leave; then its plan is taken."""
    plan, counts = Plan(capacity), {n: c for n, c in counts.items() if c}
    plain = Plan(capacity)
    best_fit(plain, dict(counts))
    reduce_instance(plan, counts)
    best_fit(plan, counts)
    return plan if plan.sequences <= plain.sequences else plain


def _classes() -> tuple[str, str]:
    """Letters and numbers below U+0250, as bodies of character classes."""
    esc = lambda kind: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)
    return esc("L"), esc("N")


class WordEncoder:
    """ids of the word vocabulary, as little-endian 32-bit bytes, exactly as its tokenizer gives them.

    The tokenizer splits into words before it merges, so ids of words may be kept and joined. Texts with
    characters whose treatment needs the tokenizer's own Unicode tables go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab().items() if t.endswith(self.tok.model.end_of_word_suffix or "")]] = True
        letter, number = _classes()
        self.plain = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-įĲ-ňŊ-ɏ]*")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^ \\t\\n\\r\\x0b\\x0c{letter}{number}]+")
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts together, so that their new words make one call of the tokenizer."""
        memo = self.memo
        split = [None if "<|" in t or not self.plain.fullmatch(t) else self.split.findall(t.lower()) for t in texts]
        new = set().union(*[words for words in split if words]).difference(memo)
        long = self._learn(sorted(new)) if new else {}
        out = []
        for t, words in zip(texts, split):
            if words is None:
                out.append(self.whole(t))
            elif long:
                out.append(b"".join([memo[w] if w in memo else long[w] for w in words]))
            else:
                out.append(b"".join(map(memo.__getitem__, words)))
        if self.held > CACHE:  # words met early are the frequent ones
            self.memo = dict(itertools.islice(memo.items(), len(memo) // 3))
            self.held //= 3
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Keep the ids of words; those of unusual length are given back instead. Words joined by blanks stay apart."""
        long = {}
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            apart = len(ends) == len(part)
            flat, i = ids.tobytes(), 0
            for w, j in zip(part, (4 * ends).tolist() if apart else itertools.repeat(0)):
                (self.memo if len(w) < 64 else long)[w] = flat[i:j] if apart else self.whole(w)
                i = j
            self.held += 200 * len(part)  # the two objects and their place in the table
        return long


def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end token, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The encoder goes with the task: a worker serves other stages later on.
        enc, stop = encoder(path), end.to_bytes(4, "little")
        for b in slices(batches, 64):
            cols = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all([t or "" for t in b.column(1).to_pylist()])):
                ids += stop
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(cols, (doc, p, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces must read alike each time (a table, or cut())."""
    spark = pieces.sparkSession
    n = pieces.count()
    # Pieces of one length are ranked in sub-buckets, so that a common length is no single task.
    subs = max(4, min(4096, n // 4096))
    keyed = pieces.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(subs)).cast("int"))
    counts = keyed.groupBy("length", "sub").agg(F.count("*").alias("c"))
    ahead = counts.select("length", "sub", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # At most `capacity` rows come to the driver, and the plan's places are as bounded.
    plan = plan_packing({r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}, capacity)
    places = spark.createDataFrame([(p.length, p.rank, p.rank + p.bins * p.per_bin, p.per_bin, p.sequence, p.offset) for p in plan.places], "plen long, lo long, hi long, per_bin long, sequence long, at long")
    within = F.row_number().over(Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = keyed.join(ahead, ["length", "sub"]).withColumn("rank", F.col("ahead") + within - 1)
    put = ranked.join(F.broadcast(places), (F.col("length") == F.col("plen")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return put.select(*pieces.columns, (F.col("sequence") + F.expr("(rank - lo) div per_bin")).alias("sequence_id"), (F.col("at") + nth % F.col("per_bin") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenize once, write the pieces' lengths, plan, place. The ids themselves are rebuilt by whoever writes them."""
    return pack(cut(token_pieces(docs, path, id_col, text_col, capacity, end), "pieces"), capacity)
