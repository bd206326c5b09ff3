"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its inner s-mers lies at its first or
last place. The choice looks at the k-mer alone, so equal passages yield equal anchors wherever they stand.
The fingerprint is a one-permutation sketch of the anchors' hashes: BINS bytes in hex, `ff` for an empty bin.

Defined results: null text counts as empty; an empty text has an all-`ff` fingerprint; any other text without a
closed syncmer (shorter than k, or than 2k - s and unlucky) has its whole self as only feature; equal texts have equal fingerprints; two empty fingerprints have likeness 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import mix64, quoted, slices, sliding_min

K, S, BINS = 16, 6, 128
_P = np.uint64(0x2545F4914F6CDD1D)
#: Ranges of ids are at most so many at first, of so many rows at least, and cut so often.
MAX_BLOCKS, BLOCK_ROWS, LEVELS = 65536, 400, 4
_LOWEST = -(2**63)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _whole(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's whole self as its only feature."""
    h = np.uint64(len(codes))
    with np.errstate(over="ignore"):
        for c in codes:
            h = h * _P + c
    return np.zeros(1, np.int64), mix64(np.array([h]))


def syncmers(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (code points) and 64-bit hashes of the closed syncmers of a text."""
    codes = _codes(text)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(codes) < k:
        return _whole(codes)
    n, w = len(codes) - s + 1, k - s + 1
    h = codes[:n].copy()
    for i in range(1, s):
        h *= _P
        h += codes[i : i + n]
    h = mix64(h)
    low = sliding_min(h, w)
    at = np.flatnonzero((h[: len(low)] == low) | (h[w - 1 :] == low))
    if not len(at):
        return _whole(codes)
    g = codes[at]
    for i in range(1, k):
        g *= _P
        g += codes[at + i]
    return at, mix64(g)


def sketch(hashes: np.ndarray, bins: int = BINS) -> bytes:
    """One byte a bin: the scrambled smallest hash modulo 255, or 255 where the bin is empty."""
    out = np.full(bins, 255, np.uint8)
    if len(hashes):
        h = np.sort(hashes)
        b = (h >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        out[b[first]] = (mix64(h[first] ^ np.uint64(0xA5A5)) % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common anchors among all anchors of two texts, 0 to 1."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    used = (x != 255) | (y != 255)
    same = np.count_nonzero((x == y) & used) / np.count_nonzero(used)
    return max(0.0, (same - 1 / 255) / (1 - 1 / 255))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row per anchor of every document: (doc_id, position, hash). Empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, t in zip(batch.column(0), batch.column(1)):
                at, h = syncmers(t.as_py() or "", k, s)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(h.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, position long, hash long")


_OUT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
)


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by the start of the following one."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def id_blocks(rows: DataFrame, most: int = MAX_BLOCKS, size: int = BLOCK_ROWS, levels: int = LEVELS) -> tuple[DataFrame, int]:
    """rows(ord, ...) with `block`, numbers of ranges of ord in ascending order, and how many there may be.

    The ids' span is cut into equal ranges. Ranges that hold over four times `size` rows are cut again, between their own
    least and greatest id, and so on, so that ids in clusters don't share one range. Counting reads ids only, and what
    comes to the driver, and is broadcast, are a few numbers for each of at most 2 * most ranges.
    """
    n, lo, hi = rows.agg(F.count("*"), F.min(F.nullif("ord", F.lit(_LOWEST))), F.max(F.nullif("ord", F.lit(_LOWEST)))).first()
    if lo is None:
        return rows.withColumn("block", F.lit(-1)), 1
    cut = lambda first, width: F.floor((F.col("ord").cast("decimal(20,0)") - first.cast("decimal(20,0)")) / width.cast("decimal(20,0)")).cast("int")
    whole = lambda x: F.lit(str(x))  # noqa: E731  widths may exceed 64 bits
    blocks = max(1, min(most, n // size))
    rows = rows.withColumn("block", F.when(F.col("ord") == _LOWEST, F.lit(-1)).otherwise(cut(whole(lo), whole((hi - lo) // blocks + 1))))
    for _ in range(levels):
        held = rows.select("ord", "block").groupBy("block").agg(F.count("*").alias("c"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).collect()
        parts = {r["block"]: min(r["hi"] - r["lo"] + 1, -(-r["c"] * blocks // n)) if r["c"] > 4 * max(size, n // most) else 1 for r in held}
        if max(parts.values()) == 1:
            break
        table, at = [], 0
        for r in sorted(held, key=lambda r: r["block"]):
            table.append((r["block"], at, r["lo"], (r["hi"] - r["lo"]) // parts[r["block"]] + 1))
            at += parts[r["block"]]
        finer = rows.sparkSession.createDataFrame([(b, k, f, str(w)) for b, k, f, w in table], "old int, base int, first long, width string")
        rows = rows.join(F.broadcast(finer), F.col("block") == F.col("old")).withColumn("block", F.col("base") + cut(F.col("first"), F.col("width"))).drop("old", "base", "first", "width")
        blocks = max(blocks, at)
    return rows, blocks


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (see edited_text), the following text being that of the
    next larger id, or of the first for the last.

    Ids are cut into ranges (see id_blocks); the first document of each range also goes to the range before it, so
    each range is handled on its own, streamed in id order: texts are shuffled once. Rows with the same id keep
    their texts' order; null ids come first. One row per input row; an empty table gives no rows; other columns are
    not read.
    """
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("ord", F.coalesce("doc_id", F.lit(_LOWEST)))
    base, blocks = id_blocks(base)
    heads = base.groupBy("block").agg(F.min("ord").alias("head"))
    order = Window.orderBy("block")  # over at most 2 * MAX_BLOCKS + 1 rows
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("block").over(order), F.last("block").over(everywhere)).alias("before"), F.lag("block").over(order).isNull().alias("wraps"))
    # Repeated rows of the first id all travel; the sort takes the first of them.
    rows = base.join(F.broadcast(heads), F.col("ord") == F.col("head"), "left").select(
        "doc_id", "text", "ord",
        F.explode(F.filter(F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("block"), F.lit(1).alias("ahead")))), lambda x: x.isNotNull())).alias("at"),
    )
    rows = rows.select("at.block", "at.ahead", "ord", "doc_id", "text")
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(min(parts, blocks), "block").sortWithinPartitions("block", "ahead", "ord", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = None, None, []

        def close(following):
            doc, text, fp = held
            nxt, nfp = following
            edited = edited_text(text, nxt)
            efp = sketch(syncmers(edited)[1])
            out.append((doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, nfp)))

        for batch in slices(batches):
            for block, ahead, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if ahead and held is None:
                    continue  # a further copy of the following head
                text = text.as_py()
                fp = sketch(syncmers(text)[1])
                if held is not None:
                    close((text, fp))
                held = None if ahead else (doc, text, fp)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], schema=_arrow)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], schema=_arrow)

    _arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return rows.mapInArrow(run, _OUT)
