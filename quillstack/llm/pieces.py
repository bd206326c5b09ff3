"""Encoding and decoding with a SentencePiece vocabulary: Aho-Corasick matches drive a one-pass Viterbi.

The automaton over all pieces reports, at every character, each piece ending there by following its output
links; since all shorter prefixes are final by then, each report relaxes the best score at its end at once. The
result is the segmentation of largest total score; ties go to the longer last piece. Characters that no piece
spells become their UTF-8 bytes' pieces, at a penalty below every score. Decoding gives back the exact text.

Defined results: null and empty texts have no ids; a literal U+2581 is spelled in bytes, since the piece of that
look stands for a space; repeated rows are rows of their own, an empty table gives no rows, further columns are not
read. Texts are streamed row by row, whole ones of any length; nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices

SPACE = "▁"
#: Segmentations of single words that a task keeps, some 250 bytes each, given back with the task; bounds memory, the result isn't touched.
CACHE = 400_000
UNKNOWN_PENALTY = 10.0


class PieceCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_: dict[int, int] = {}
        self.text: list[bytes] = []
        self.singles: set[str] = set()
        self.auto = ahocorasick.Automaton()
        lowest, crossing = 0.0, False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
                continue
            self.text.append(piece.replace(SPACE, " ").encode())
            score = sp.get_score(i)
            lowest = min(lowest, score)
            self.auto.add_word(piece, (len(piece), score, i))
            crossing |= SPACE in piece.lstrip(SPACE)
            if len(piece) == 1:
                self.singles.add(piece)
        self.auto.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        #: Where no piece reaches over the start of a run of spaces, the best paths of words add up to the best of all.
        self.units = re.compile(r" *[^ ]+| +") if not crossing else re.compile(r".+", re.DOTALL)
        self.memo: dict[str, tuple[bytes, float]] = {}

    def _segment(self, unit: str) -> tuple[bytes, float]:
        """Ids (little-endian 32-bit) and score of the best segmentation; unit starts with its spaces."""
        blanks = len(unit) - len(unit.lstrip(" "))
        u = SPACE * blanks + unit[blanks:].replace(SPACE, "\x00").replace(" ", SPACE)
        literal = SPACE in unit
        n = len(u)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        singles, done = self.singles, 0
        odd = [i for i in range(n) if u[i] not in singles]
        odd_at = 0

        def strange(upto: int) -> None:
            nonlocal odd_at
            while odd_at < len(odd) and odd[odd_at] < upto:
                p = odd[odd_at]
                if best[p] + self.unknown > best[p + 1]:
                    best[p + 1], back[p + 1] = best[p] + self.unknown, (1, None)
                odd_at += 1

        for end, (size, score, i) in self.auto.iter(u):
            if odd and end > done:
                strange(end)
            done = end
            e = end + 1
            s = best[e - size] + score
            if s > best[e]:
                best[e], back[e] = s, (size, i)
        strange(n)
        ids, e = [], n
        while e:
            size, i = back[e]
            if i is None:
                c = u[e - 1]
                raw = (SPACE if literal and c == "\x00" and unit[e - 1] == SPACE else c).encode()
                ids.extend(self.bytes_[b] for b in reversed(raw))
            else:
                ids.append(i)
            e -= size
        ids.reverse()
        return array("i", ids).tobytes(), best[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian 32-bit numbers, and their total score."""
        if not text:
            return b"", 0.0
        memo, out, total = self.memo, [], 0.0
        for unit in self.units.findall(" " + text):
            got = memo.get(unit)
            if got is None:
                got = self._segment(unit)
                if len(unit) < 40:
                    if len(memo) >= CACHE:
                        memo.clear()
                    memo[unit] = got
            out.append(got[0])
            total += got[1]
        return b"".join(out), total

    def decode(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in array("i", ids)]).decode("utf-8", "surrogatepass")[1:]


def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, score) per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)  # it goes with the task: a worker serves other stages later on
        for b in slices(batches, 64):
            got = [c.encode(t.as_py() or "") for t in b.column(1)]
            flat = np.frombuffer(b"".join([ids for ids, _ in got]), "<i4")
            ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "ids", "score"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode_documents(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x.values if x.is_valid else [], "<i4").tobytes()) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return ids.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(ids_col)).alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, score, round_trip): ids in digest, and whether decoding gave the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            n, crc, score, same = [], [], [], []
            for t in b.column(1):
                t = t.as_py() or ""
                ids, s = c.encode(t)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                score.append(s)
                same.append(c.decode(ids) == t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(score, pa.float64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "score", "round_trip"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, score double, round_trip boolean")
