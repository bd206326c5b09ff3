"""A stored index of vectors in clusters: nearest rows by reading few clusters, exact by proof, and similarity joins that skip
pairs of clusters.

The folder holds

    rows/cluster=C     id, v, block     vectors of a cluster, in blocks of a bounded number of rows
    clusters           cluster, centre, radius, n, blocks     a centre of unit length, the largest angle of a row to it

The angle between a query and any row of a cluster is at least that to the centre less the radius (angles obey the triangle
inequality), so no row's cosine is above the cosine of that. A query first reads the clusters of highest bound that hold k rows;
its k-th result then proves away every cluster whose bound is below it, and the others are read: two rounds, whatever the data.
Centres are fitted on a bounded sample; every row is in the index, and results are those of comparing all rows.
Rows of zero length, whose cosine is 0 to everything, are cluster -1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.sources.shared import cut

from .vectors import best_pairs, unit

#: Rows of a block; clusters, at most; rows that centres are fitted on, at most, and rounds of fitting; queries of a block.
BLOCK, CLUSTERS, SAMPLE, ROUNDS, ASKED = 4096, 1024, 16_384, 8, 1024
#: Rows of a tile, about: a similarity join copies a row to as many tasks as there are tiles that it may have to do with. Smaller tables have
#: smaller tiles, of this many rows at least, as long as there are no more than so many.
TILE, SMALL_TILE, TILES = 32_768, 1024, 8
#: Bounds are widened by what rounding to six places and sums of products may differ by.
SLACK = 2e-6


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def fit_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit length by spherical k-means from evenly spread starts. The sample is in one order, so that the same
    rows give the same centres."""
    x = unit(sample)
    x = x[(x * x).sum(1) > 0]
    if not len(x):
        return np.zeros((0, sample.shape[1]))
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where((np.abs(total).sum(1) > 0)[:, None], unit(total), centres)
    return np.unique(centres, axis=0)


def highest(x: np.ndarray, ids: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros((len(x), 0))
    return np.where(ids == -1, 0.0, np.cos(np.maximum(angles(unit(x), centres) - radius, 0.0))) + SLACK


class VectorIndex:
    """An index in a folder, of vectors of one dimension; ids are longs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        got = sorted(spark.read.parquet(f"{self.path}/clusters").collect(), key=lambda r: r["cluster"])  # CLUSTERS + 1 rows at most
        self.ids = np.array([r["cluster"] for r in got], np.int64)
        self.centres = np.array([r["centre"] for r in got], np.float64).reshape(len(got), -1) if got else np.zeros((0, 0))
        self.radius, self.n, self.blocks = (np.array([r[c] for r in got]) for c in ("radius", "n", "blocks"))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", dim: int | None = None, clusters: int | None = None, block: int = BLOCK, sample: int = SAMPLE) -> VectorIndex:
        """Rows of null vectors, or of another dimension than `dim` (that of most rows, if not given), are left out."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d")
        first = sizes.filter(F.lit(True) if dim is None else F.col("d") == dim).first()
        dim, n = (first["d"], first["n"]) if first else (dim or 1, 0)
        rows = rows.filter(F.size("v") == dim)
        # The sample: rows of smallest hash, so that it does not depend on how the table lies.
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        wanted = clusters or max(1, min(CLUSTERS, int(n**0.5)))
        centres = fit_centres(np.array([r["v"] for r in picked]).reshape(len(picked), -1), min(wanted, CLUSTERS)) if picked else np.zeros((0, dim))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim))
                zero = (x * x).sum(1) == 0
                if len(centres):
                    a = angles(x, centres)
                    own, away = np.argmin(a, 1), a.min(1)
                else:
                    own, away = np.full(len(x), -1), np.zeros(len(x))
                own, away = np.where(zero, -1, own), np.where(zero, 0.0, away)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(away)], ["id", "v", "cluster", "away"])

        dealt = cut(rows.mapInArrow(deal, "id long, v array<double>, cluster int, away double"), "dealt")
        at = spark.createDataFrame([(-1, [0.0] * dim), *((k, c.tolist()) for k, c in enumerate(centres))], "cluster int, centre array<double>")
        held = dealt.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        held.join(at, "cluster").coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
        held = spark.read.parquet(f"{path}/clusters").select("cluster", "blocks")
        out = dealt.join(F.broadcast(held), "cluster").select("id", "v", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "cluster")  # CLUSTERS + 1 rows
        out.repartition("cluster", "block").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
        return cls(spark, path)

    def rows(self, clusters: Sequence[int] | None = None) -> DataFrame:
        df = self.spark.read.schema("id long, v array<double>, block int, cluster int").parquet(f"{self.path}/rows")
        return df if clusters is None else df.filter(F.col("cluster").isin([int(c) for c in clusters]))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The highest cosine that a row of each cluster may have to each query."""
        return highest(x, self.ids, self.centres, self.radius)

    def _reads(self, queries: DataFrame, key: Sequence[str], k: int) -> DataFrame:
        """(key..., vector, cluster, block): what a query is to read. queries(key..., vector, least): without `least` the clusters of
        highest bound that hold k rows, with it those of a bound as high that it has not read."""
        ids, n, blocks, centres, radius, names = self.ids, self.n, self.blocks, self.centres, self.radius, [*key, "vector"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x = np.array(b.column(len(key)).to_pylist(), np.float64)
                top, least = highest(x, ids, centres, radius), b.column(len(key) + 1).to_pylist()
                owner, cluster, block = [], [], []
                for q, bound in enumerate(top):
                    order = np.argsort(-bound, kind="stable")
                    first = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                    chosen = order[:first] if least[q] is None else (rest := order[first:])[bound[rest] >= least[q]]
                    for c in chosen:
                        owner += [q] * int(blocks[c])
                        cluster += [int(ids[c])] * int(blocks[c])
                        block += range(int(blocks[c]))
                part = b.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(cluster, pa.int32()), pa.array(block, pa.int32())], [*names, "cluster", "block"])

        kinds = dict(queries.dtypes)
        return queries.select(*names, "least").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cluster int, block int")

    def _nearest(self, reads: DataFrame, key: Sequence[str], k: int) -> DataFrame:
        """(key..., id, sim): the k best of every block that a query reads."""
        kinds = dict(reads.dtypes)
        key = list(key)
        split = max(1, -(-reads.select(*key).distinct().count() // ASKED))
        clusters = [r["cluster"] for r in reads.select("cluster").distinct().collect()]  # CLUSTERS + 1 at most
        asked = reads.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(split)).cast("int"))
        rows = self.rows(clusters).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))

        def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({**{c: q[c][:0] for c in key}, "id": np.empty(0, np.int64), "sim": np.empty(0)})
            if not len(x) or not len(q):
                return empty
            m, ids, out = unit(np.array(x["v"].to_list())), x["id"].to_numpy(), []
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                sim = np.round(unit(np.array(part["vector"].to_list())) @ m.T, 6) + 0.0
                keep = np.lexsort((np.broadcast_to(ids, sim.shape), -sim))[:, :k]
                found = part[key].iloc[np.repeat(np.arange(len(part)), keep.shape[1])].reset_index(drop=True)
                found["id"], found["sim"] = ids[keep].ravel(), np.take_along_axis(sim, keep, 1).ravel()
                out.append(found)
            return pd.concat(out)

        schema = ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", id long, sim double"
        return rows.groupBy("cluster", "block", "part").cogroup(asked.groupBy("cluster", "block", "part")).applyInPandas(best, schema)

    def topk(self, queries: DataFrame, by: Sequence[str] = ("q",), k: int = 30) -> DataFrame:
        """(by..., id, sim, rank), written: each query's k nearest rows by cosine rounded to six places, ties to smaller ids.
        queries(by..., vector), each told by `by`; null vectors and those of another dimension have no result. reads of the result
        tells how much was read."""
        by = list(by)
        fits = F.col("vector").isNotNull() & (F.size("vector") == self.centres.shape[1]) if len(self.ids) else F.lit(False)
        asked = queries.filter(fits).select(*by, F.col("vector").cast("array<double>").alias("vector"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sim"), "id"))
        first = cut(self._reads(asked.withColumn("least", F.lit(None).cast("double")), by, k), "reads")
        near = cut(self._nearest(first, by, k).withColumn("rank", place).filter(F.col("rank") <= k), "near")
        # Fewer than k results prove nothing away.
        known = near.filter(F.col("rank") == k).select(*by, F.col("sim").alias("least"))
        second = cut(self._reads(asked.join(known, by, "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), by, k), "reads")
        more = self._nearest(second, by, k)
        out = cut(near.drop("rank").unionByName(more).withColumn("rank", place).filter(F.col("rank") <= k), "near")
        out.reads = first.unionByName(second)
        return out

    def report(self, result: DataFrame, by: Sequence[str] = ("q",)) -> DataFrame:
        """(by..., clusters, rows, of_clusters, of_rows): what a topk() result took to read, of what there is."""
        sizes = self.spark.createDataFrame([(int(c), int(n)) for c, n in zip(self.ids, self.n)], "cluster int, n long")
        read = result.reads.select(*by, "cluster").distinct().join(F.broadcast(sizes), "cluster")  # CLUSTERS + 1 rows
        return read.groupBy(*by).agg(F.count("*").alias("clusters"), F.sum("n").alias("rows")).withColumns({"of_clusters": F.lit(len(self.ids)), "of_rows": F.lit(int(self.n.sum()))})

    def meetings(self, threshold: float) -> np.ndarray:
        """Pairs of clusters, a <= b, in which two rows may be as similar as the threshold."""
        if not len(self.ids):
            return np.empty((0, 2), np.int64)
        apart = angles(self.centres, self.centres) - self.radius[:, None] - self.radius[None, :]
        zero = self.ids == -1
        bound = np.where(zero[:, None] | zero[None, :], 0.0, np.cos(np.clip(apart, 0.0, np.pi))) + SLACK
        np.fill_diagonal(bound, np.where(zero, SLACK, 1.0))
        a, b = np.nonzero(np.triu(bound >= threshold))
        return np.stack([a, b], 1)

    def tiles(self, met: np.ndarray) -> np.ndarray:
        """The tile of each block, clusters' blocks in order: clusters follow each other from one to its nearest, and fill tiles of TILE rows at most,
        about. Clusters that meet none have the tile -1."""
        left, most = met.any(1), min(TILE, max(SMALL_TILE, int(self.n.sum()) // TILES))
        near = self.centres @ self.centres.T
        tile, rows, at = [np.full(b, -1) for b in self.blocks], 0, int(np.argmax(left))
        while left[at]:
            left[at] = False
            size = self.n[at] / self.blocks[at]
            tile[at] = ((rows + np.arange(self.blocks[at]) * size) // most).astype(int)
            rows += self.n[at]
            at = int(np.argmax(np.where(left, near[at], -np.inf)))
        return np.concatenate(tile)

    def similar(self, threshold: float, k: int | None = None) -> DataFrame:
        """(a, b, sim): rows of cosine >= threshold, rounded to six places, each with its k best others (all, if None), both ways.
        Only clusters that may hold such rows meet. Blocks meet by tiles, so that a row is copied once for each other tile, at most, and a task
        holds two tiles."""
        pairs, schema = self.meetings(threshold), "a long, b long, sim double"
        if not len(pairs):
            return self.spark.createDataFrame([], schema)
        met = np.zeros((len(self.ids), len(self.ids)), bool)
        met[pairs[:, 0], pairs[:, 1]] = met[pairs[:, 1], pairs[:, 0]] = True
        owner, block = np.repeat(np.arange(len(self.ids)), self.blocks), np.concatenate([np.arange(b) for b in self.blocks])
        tile = self.tiles(met)
        # Which clusters have to do with a tile's.
        reach = np.stack([met[:, np.unique(owner[tile == t])].any(1) for t in range(tile.max() + 1)], 1)
        unit_, other = np.nonzero(reach[owner] & (tile >= 0)[:, None])
        own = tile[unit_]
        dealt = pd.DataFrame({"cluster": self.ids[owner[unit_]], "block": block[unit_], "ta": np.minimum(own, other), "tb": np.maximum(own, other), "second": own > other, "at": owner[unit_]})
        places = self.spark.createDataFrame(dealt, "cluster int, block int, ta int, tb int, second boolean, at int")

        def best(rows: pa.Table) -> pa.Table:
            rows, parts = rows.combine_chunks(), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            ids, at, second = rows["id"].to_numpy(), rows["at"].to_numpy(), rows["second"].to_numpy(zero_copy_only=False)
            v = unit(rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1))
            # One tile's rows among themselves, or those of two tiles, both ways.
            one = rows["ta"][0] == rows["tb"][0]
            for x, y in ((~second, ~second),) if one else ((~second, second), (second, ~second)):
                if not x.any() or not y.any():
                    continue
                if met[np.ix_(np.unique(at[x]), np.unique(at[y]))].all():
                    parts.append(best_pairs(v[x], ids[x], v[y], ids[y], k, threshold, same=False))
                    continue
                for c in np.unique(at[x]):
                    few, others = x & (at == c), y & met[c, at]
                    if others.any():
                        parts.append(best_pairs(v[few], ids[few], v[others], ids[others], k, threshold, same=False))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], ["a", "b", "sim"])

        rows = self.rows().join(places, ["cluster", "block"]).select("id", "v", "at", "ta", "tb", "second")
        found = rows.groupBy("ta", "tb").applyInArrow(best, schema)
        if k is None:
            return found
        return found.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("n") <= k).drop("n")
