"""SimHash near-duplicates by covering locality-sensitive hashing.

64-bit fingerprints are compared only where a covering mask makes them collide: bit i gets a non-zero vector
m(i) of R + 1 bits, and mask v keeps the bits with odd <m(i), v>. Any R differing bits span at most R dimensions,
so some v is orthogonal to all of them and its mask skips them: every pair within the radius meets in a table.
Buckets that stay large are split again by the same construction over the bits still free, at the last level
few bits are free and a bucket is bounded by their combinations. Buckets emit a spanning star for each cluster
of linked fingerprints, never all pairs, and the stars are joined by connected components.

Defined results: words are maximal runs of bytes other than space and \\t\\n\\v\\f\\r, after lower-casing A-Z; fewer
than three words form one shingle; no words (null, empty or blank text) give fingerprint zero, which links like
any other. Repeated rows stay rows. Rows with a null id carry their component but never name it. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import components, cut, quoted, slices

RADIUS, WORDS, SEED = 3, 3, 42
#: Buckets above this are split by the next level's masks; the last level keeps what it gets.
BUCKET, LEVELS = 512, 3


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of word shingles, repeats counted."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return 0
    joined, n = b" ".join(toks), max(1, len(toks) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in toks]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends[min(words, len(toks)) - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 65536)], ends[at : at + 65536])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed long. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """The 2**(radius+1) - 1 masks of one level, as unsigned 64-bit numbers."""
    size = (1 << radius + 1) - 1
    # Each level deals the bits' vectors out anew, so that it also halves what earlier masks have left free.
    vec = [1 + (i * (1, 4, 7)[level % 3] + (0, i // 5, i // 3 * 2)[level % 3]) % size for i in range(64)]
    return [sum(1 << i for i in range(64) if (vec[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def clusters(x: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the smallest index of its cluster under links within the radius."""
    n = len(x)
    label = np.arange(n)
    rows = max(1, 4_000_000 // n)
    while True:
        new = label.copy()
        for at in range(0, n, rows):
            near = np.bitwise_count(x[at : at + rows, None] ^ x[None, :]) <= radius
            new[at : at + rows] = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Edges (a, b) between representatives of fps(fp, rep): spanning stars of every bucket's clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, xs, reps = None, [], []

        def close() -> pa.RecordBatch | None:
            x, rep = np.concatenate(xs).view(np.uint64), np.concatenate(reps)
            at = clusters(x, radius)
            own = np.flatnonzero(at != np.arange(len(at)))
            return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[at[own]])], ["a", "b"]) if len(own) else None

        for batch in batches:
            keys, x, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            a, b = [], []
            for s, e in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[s] != key:
                    if xs and (out := close()):
                        yield out
                    key, xs, reps = keys[s], [], []
                if s and e < len(keys) and e - s == 2:  # a whole pair, the usual case
                    if ((int(x[s]) ^ int(x[s + 1])) & (2**64 - 1)).bit_count() <= radius:
                        a.append(rep[s + 1])
                        b.append(rep[s])
                    continue
                xs.append(x[s:e])
                reps.append(rep[s:e])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if xs and (out := close()):
            yield out

    todo = fps.select(F.lit(0).cast("long").alias("grp"), F.lit(-1).cast("long").alias("free"), "fp", "rep")
    found = None
    for level in range(levels):
        masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius, level)])
        # The mask's number is part of the group, so that tables don't mix.
        rows = todo.select("grp", "free", "fp", "rep", F.posexplode(masks).alias("v", "mask"))
        rows = rows.select(F.xxhash64("grp", "v", F.col("fp").bitwiseAND(F.col("mask")).bitwiseAND(F.col("free"))).alias("grp"), F.col("free").bitwiseAND(F.bitwise_not("mask")).alias("free"), "fp", "rep")
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("grp"))).filter("n > 1")
        last = level == levels - 1
        small = rows if last else rows.filter(F.col("n") <= bucket)
        part = small.select("grp", "fp", "rep").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")
        found = part if found is None else found.union(part)
        if last:
            break
        todo = cut(rows.filter(F.col("n") > bucket).select("grp", "free", "fp", "rep"), "buckets")
        if todo.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row; copies share a fingerprint and meet once."""
    own = cut(fingerprints(docs, id_col, text_col, words), "simhash")
    fps = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"), "simhash")
    comp = components(links(fps, radius))
    named = fps.join(comp, fps.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
