"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are dealt to blocks by the nearest of a few centres. A block holds its postings (dimension, row, value) in
segments of descending quantised impact |value|, and the least and greatest value of each dimension. A query reads the
block of its own centre first; its k-th score there is what other blocks must reach. A block whose bounds prove that
it can't is not read for the query. In a block, whole segments are added to the scores of a chunk of queries, and for
every vector a bound is kept on what its unread postings can still add or take away (their Euclidean norm times the
query's). Reading stops only when the bounds prove that every member of the top k is among a few possible ones, which
are scored exactly.

The centres are fitted on at most SAMPLE vectors and decide on the work only, never on the result.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; shorter vectors
count as padded with zeros; an empty vector scores 0; a row never answers a query of its own id; equal scores go
to the smaller id, repeated rows stay apart; an empty table gives no rows; other columns are not read, whatever their
names. Exact for scores of 64 bits; components beyond 64 bits count as the nearest such number, and so do scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted

#: Rows of a block, of a group of queries, and of a chunk of it; segments of a block.
BLOCK_ROWS, QUERY_ROWS, CHUNK, SEGMENTS = 8192, 4096, 128, 8
#: Vectors that the centres are fitted on, and centres, at most.
SAMPLE, CENTRES = 4096, 256


def quantise(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; unusable vectors dropped."""
    x = F.col(quoted(vec_col)).cast("array<double>")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(ok & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def cut_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """quantise(), written out, since it is counted, indexed and queried."""
    return cut(quantise(df, id_col, vec_col), "vectors")


def _matrix(vectors, dim: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), dim), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:dim]
    return out


def centres_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors in the middle of k groups of like direction."""
    unit = sample / np.maximum(np.sqrt((sample * sample).sum(1)), 1e-9)[:, None]
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)] if len(unit) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds if len(unit) else 0):
        own = (unit @ centres.T).argmax(1)
        for c in np.unique(own):
            centre = unit[own == c].sum(0)
            centres[c] = centre / max(np.sqrt(centre @ centre), 1e-9)
    return centres


class Index:
    """blocks: DataFrame of one row per block; home(v): the block whose vectors are most like v."""

    def __init__(self, blocks: DataFrame, centres: np.ndarray, first: list[int], count: int):
        self.blocks, self.centres, self.first, self.count = blocks, centres, first, count

    def home(self, v: Column) -> Column:
        return F.element_at(F.array(*[F.lit(b) for b in self.first]), nearest(self.centres, v) + 1)


def nearest(centres: np.ndarray, v: Column) -> Column:
    @F.pandas_udf("int")
    def own(vs: pd.Series) -> pd.Series:
        return pd.Series((_matrix(vs, centres.shape[1]) @ centres.T).argmax(1).astype(np.int32))

    return own(v)


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, segments: int = SEGMENTS) -> Index:
    """Blocks of at most about block_rows vectors: ids, bounds, and postings in segments of descending impact."""
    n = vectors.count()
    share = min(1 << 20, -(-SAMPLE * (1 << 20) // max(1, n)))
    some = [r["v"] for r in vectors.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)) < share).limit(SAMPLE).select("v").collect()]
    centres = centres_of(_matrix(some, max(map(len, some), default=1) or 1), min(CENTRES, max(1, -(-n // block_rows))))
    dealt = cut(vectors.withColumn("centre", nearest(centres, F.col("v"))), "dealt")
    held = {r["centre"]: r["n"] for r in dealt.groupBy("centre").agg(F.count("*").alias("n")).collect()}  # CENTRES rows at most
    parts = [max(1, -(-held.get(c, 0) // block_rows)) for c in range(len(centres))]
    first = [0, *np.cumsum(parts).tolist()]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("centre") + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        whole = _matrix(pdf["v"].to_list(), max(map(len, pdf["v"])), np.int64)
        m = whole.astype(np.float64)
        row, dim = np.nonzero(whole)
        value = m[row, dim]
        top = np.abs(value).max(initial=0)
        # Impact classes are equal steps of |value|; the last holds the smallest.
        level = np.minimum(((top - np.abs(value)) * segments / max(top, 1)).astype(np.int64), segments - 1)
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(segments), "right")
        out = {"block": int(pdf["block"].iloc[0]), "dim": m.shape[1], "ids": pdf["vec_id"].to_numpy(np.int64), "low": m.min(0), "high": m.max(0), "ends": ends.astype(np.int64), "rows": row[order].astype(np.int32), "dims": dim[order].astype(np.int32), "vals": whole[row, dim][order]}
        return pd.DataFrame([{c: x.tobytes() if isinstance(x, np.ndarray) else x for c, x in out.items()}])

    blocks = dealt.withColumn("block", (pick(first[:-1]) + F.pmod(F.xxhash64("vec_id", "v"), pick(parts))).cast("int"))
    blocks = blocks.groupBy("block").applyInPandas(run, "block int, dim int, ids binary, low binary, high binary, ends binary, rows binary, dims binary, vals binary")
    # Written, so that it is built once however often it is searched.
    return Index(cut(blocks, "index"), centres, first[:-1], first[-1])


class Block:
    """A block read back. segments: of all chunks of queries that came to it; read: those that were added."""

    TYPES = {"ids": np.int64, "low": np.float64, "high": np.float64, "ends": np.int64, "rows": np.int32, "dims": np.int32, "vals": np.int64}

    def __init__(self, row):
        for c, t in self.TYPES.items():
            setattr(self, c, np.frombuffer(row[c], t))
        self.dim = int(row["dim"])
        self.whole, self.vals = self.vals, self.vals.astype(np.float64)
        self.square = np.bincount(self.rows, weights=self.vals**2, minlength=len(self.ids))
        self.segments = self.read = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of the block scores more with the queries."""
        return np.maximum(q * self.low, q * self.high).sum(1)

    def dense(self, start: int, end: int) -> np.ndarray:
        out = np.zeros((len(self.ids), self.dim))
        out[self.rows[start:end], self.dims[start:end]] = self.vals[start:end]
        return out

    def exact(self, q: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        """Scores of pairs in whole numbers; in Python's where 64 bits might not hold the sum."""
        full = np.zeros((len(self.ids), self.dim), np.int64)
        full[self.rows, self.dims] = self.whole
        room = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(self.vals).max(initial=0)) * max(1, self.dim)
        if room < 2**62:
            return np.concatenate([np.einsum("ij,ij->i", q[qi[s : s + 100_000]], full[vi[s : s + 100_000]]) for s in range(0, max(1, len(qi)), 100_000)])
        most = 2**63 - 1
        return np.array([max(-most - 1, min(most, sum(int(a) * int(b) for a, b in zip(q[i], full[j])))) for i, j in zip(qi, vi)], np.int64)

    def search(self, qids: np.ndarray, whole: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows that score `least` or more, for each query of a chunk: query ids, vector ids, scores."""
        n, own, start, q = len(self.ids), qids[:, None] == self.ids[None, :], 0, whole.astype(np.float64)
        norm, acc, rest, kk, maybe = np.sqrt((q * q).sum(1)), np.zeros((len(q), n)), self.square.copy(), min(k, n), ~own
        ends = np.unique(self.ends[self.ends > 0])
        self.segments += len(ends)
        # What sums of rounded products may be off by.
        off = 1e-6 + 1e-13 * (self.dim + 2) * norm[:, None] * np.sqrt(self.square)[None, :]
        for end in ends:
            acc += q @ self.dense(start, end).T
            rest -= np.bincount(self.rows[start:end], weights=self.vals[start:end] ** 2, minlength=n)
            start = end
            self.read += 1
            bound = norm[:, None] * np.sqrt(np.maximum(rest, 0))[None, :] * (1 + 1e-9) + off
            low = np.where(own, -np.inf, acc - bound)
            kth = np.maximum(np.partition(low, n - kk, axis=1)[:, n - kk], least - 0.5 - 1e-12 * np.abs(least))
            maybe = ~own & (acc + bound >= kth[:, None])
            if maybe.sum(1).max() <= 8 * k + 32:
                break
        qi, vi = np.nonzero(maybe)
        exact = self.exact(whole, qi, vi)
        order = np.lexsort((self.ids[vi], ~exact, qi))  # ~x orders as -x does, and has no overflow
        qi, vi, exact = qi[order], vi[order], exact[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        return qids[qi[keep]], self.ids[vi[keep]], exact[keep]


def _answers(qs: pd.DataFrame, ix: pd.DataFrame, k: int, report: bool) -> pd.DataFrame:
    names = ["block", "queries", "skipped", "segments", "read"] if report else ["query_id", "vec_id", "score"]
    if not len(qs) or not len(ix):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    block = Block(ix.iloc[0])
    width = max(block.dim, max(map(len, qs["v"])))
    q, qids, least = _matrix(qs["v"].to_list(), width, np.int64)[:, : block.dim], qs["query_id"].to_numpy(np.int64), qs["least"].to_numpy(np.float64)
    found = [(np.empty(0, np.int64),) * 3]
    # Scores are whole numbers: a bound below `least` by half is below it.
    bound = block.bounds(q.astype(np.float64))
    todo = np.flatnonzero(bound + 1e-12 * np.abs(bound) > least - 0.5 - 1e-12 * np.abs(least))
    for at in range(0, len(todo), CHUNK):
        own = todo[at : at + CHUNK]
        found.append(block.search(qids[own], q[own], least[own], k))
    if report:
        return pd.DataFrame([[int(ix["block"].iloc[0]), len(q), len(q) - len(todo), block.segments, block.read]], columns=names)
    return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*found)))))


def search(index: Index, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, report: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(vec_id, v) against an index.

    Query groups of bounded size meet blocks of bounded size, so a task's memory does not grow with the data.
    Each meeting yields at most k rows a query. report: what the meetings beyond the queries' own blocks came to instead,
    (block, queries, skipped, segments, read), one row each.
    """
    groups = max(1, -(-queries.count() // query_rows))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", index.home(F.col("v")).alias("home"))
    asked = cut(asked.withColumn("grp", F.pmod(F.xxhash64("query_id", "v"), F.lit(groups)).cast("int")), "queries")
    schema = "query_id long, vec_id long, score long"
    meet = lambda q, i, keys, report: q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(lambda a, b: _answers(a, b, k, report), "block long, queries long, skipped long, segments long, read long" if report else schema)
    every = index.blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # First the block of like vectors, for what other blocks must reach.
    near = cut(meet(asked.select("query_id", "v", "grp", F.col("home").alias("block"), F.lit(float("-inf")).alias("least")), every, ["block", "grp"], False), "near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    reach = near.withColumn("n", place).filter(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("least"))
    rest = asked.join(reach, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = rest.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(0, index.count - 1))), lambda b: b != F.col("home"))))
    far = meet(rest.select("query_id", "v", "grp", "block", "least"), every, ["block", "grp"], report)
    if report:
        return far
    return near.union(far).withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
