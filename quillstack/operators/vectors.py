"""Cosine similarity: against one query vector, and nearest neighbours of all rows in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a block; pairs multiplied at once.
BLOCK, PART = 8192, 1 << 18


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; a row of zeros stays."""
    size = np.sqrt((m * m).sum(1))
    return m / np.where(size == 0, 1.0, size)[:, None]


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to a given vector. A norm of zero counts as one; a vector of another length gives null."""
    x, q = vector.cast("array<double>"), F.array(*[F.lit(float(v)) for v in query])
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    sq = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    norm = float(np.sqrt(sum(float(v) ** 2 for v in query))) or 1.0
    return F.when(F.size(vector) == len(query), dot / (F.when(sq == 0, 1.0).otherwise(F.sqrt(sq)) * F.lit(norm)))


def vectors_to_bytes(vectors: Column) -> Column:
    """Arrays of floats as little-endian 32-bit bytes, the form in which other stores keep them; null stays null."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        return pa.array([np.array(x.values, "<f4").tobytes() if x.is_valid else None for x in v], pa.binary())

    return pack(vectors)


def vectors_from_bytes(raw: Column) -> Column:
    """The reverse of vectors_to_bytes(); bytes beyond the last whole number are dropped."""

    @F.arrow_udf("array<float>")
    def unpack(b: pa.Array) -> pa.Array:
        rows = [np.frombuffer(x.as_py(), "<f4", len(x.as_py()) // 4) if x.is_valid else None for x in b]
        return pa.array(rows, pa.list_(pa.float32()))

    return unpack(raw)


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = 30, id_col: str = "id", vec_col: str = "embedding", allowed: DataFrame | None = None, exclude=None) -> DataFrame:
    """(id, sim, rank) of the k nearest rows; ranks from 1, ties to smaller ids.

    allowed(id): only these rows. The score is rounded before ranking, so that engines agree on ties.
    """
    rows = vectors.filter(F.col(vec_col).isNotNull())
    if exclude is not None:
        rows = rows.filter(F.col(id_col) != exclude)
    if allowed is not None:
        rows = rows.join(allowed.select(F.col(allowed.columns[0]).alias(id_col)), id_col, "left_semi")
    top = rows.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), query), 6).alias("sim")).filter("sim is not null").orderBy(F.desc("sim"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "id")))  # over k rows


def best_pairs(x: np.ndarray, ix: np.ndarray, y: np.ndarray, iy: np.ndarray, k: int | None, least: float | None = None, same: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sim): for each row of x its k best rows of y (all, if None), by the product rounded to six places, ties to smaller ids, and
    `least` or more, if given. x and y have length one or zero; rows of one id count as others unless same is False.

    Products in single precision say which pairs may be among them, by more than they may be wrong; only these are multiplied in double.
    """
    slack = np.float32(2e-6 + 4e-7 * (x.shape[1] + 4))
    x32, y32, out = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T), []
    odd = not (np.isfinite(x).all() and np.isfinite(y).all())
    # The k-th best of so many parts' best is no better than the k-th best of all.
    parts = 16 * (k or 1)
    for at in range(0, len(x), 512):
        s = x32[at : at + 512] @ y32
        if odd:
            np.nan_to_num(s, copy=False, nan=-2.0)
        if not same:
            s[ix[at : at + 512][:, None] == iy[None, :]] = -2.0
        bound = np.full(len(s), -3.0 if least is None else least, np.float32)
        if k is not None and k < len(iy):
            if len(iy) >= 2 * parts:
                width = len(iy) // parts
                tops = s[:, : width * parts].reshape(len(s), parts, width).max(2)
            else:
                tops = s
            bound = np.maximum(bound, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
        i, j = np.nonzero(s >= (bound - slack)[:, None])
        sim = np.concatenate([np.round(np.einsum("ij,ij->i", x[at + i[c : c + PART]], y[j[c : c + PART]]), 6) + 0.0 for c in range(0, len(i), PART)] or [np.empty(0)])
        good = np.ones(len(i), bool) if least is None else sim >= least
        if not same:
            good &= ix[at + i] != iy[j]
        i, j, sim = i[good], j[good], sim[good]
        if k is not None and len(i):
            order = np.lexsort((iy[j], -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            best = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            i, j, sim = i[best], j[best], sim[best]
        out.append((ix[at + i], iy[j], sim))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def neighbours(vectors: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "embedding", block: int = BLOCK, least: float | None = None) -> DataFrame:
    """(a, b, sim, rank): for every row its k nearest rows, itself included, by cosine rounded to 6 places; of these the
    ones of `least` or more, if given.

    Rows are dealt to blocks; each pair of blocks meets once, for the rows of both, so a task holds two blocks and no pair of
    rows is ever materialised beyond each row's k best of a block.
    """
    n = vectors.count()
    # Larger blocks are copied to fewer others; some dozens of pairs of blocks occupy a cluster.
    blocks = max(1, -(-n // block), min(12, -(-n // 1024)))
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("other", F.explode(F.sequence("own", F.lit(blocks - 1))))
    right = rows.toDF("id_", "v_", "other_").withColumn("own_", F.explode(F.sequence(F.lit(0), "other_"))).filter("own_ < other_")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (unit(np.array(t.column(1).to_pylist(), np.float64)) if t.num_rows else None for t in (a, b))
        ix, iy = a.column(0).to_numpy(), b.column(0).to_numpy()
        out = []
        if x is not None and a.column(2)[0].as_py() == a.column(3)[0].as_py():
            out = [best_pairs(x, ix, x, ix, k, least)]
        elif x is not None and y is not None:
            out = [best_pairs(x, ix, y, iy, k, least), best_pairs(y, iy, x, ix, k, least)]
        found = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64()), "sim": pa.array(found[2], pa.float64())})

    part = left.groupBy("own", "other").cogroup(right.groupBy("own_", "other_")).applyInArrow(best, "a long, b long, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k)


def similarity_edges(vectors: DataFrame, top: int = 2, threshold: float = 0.55, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(src, dst, weight): undirected edges to each row's nearest others among its top + 1 including itself."""
    near = neighbours(vectors, top + 1, id_col, vec_col, least=threshold).filter((F.col("a") != F.col("b")) & (F.col("sim") >= threshold))
    return near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "sim").groupBy("src", "dst").agg(F.round(F.max("sim"), 3).alias("weight"))
