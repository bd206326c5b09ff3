"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions only.

Each dimension is quantised to BITS bits: languages and sources by quantiles of their distinct values, so that no two
values share a cell without need, sizes by doubling. Cells are numbered along the curve by a finite-state walk over the
bits, rows are ranked by (cell, sub-bucket, id) and equal runs of ranks are the shards: sizes differ by one
row at most, and a shard covers few cells, so its minima and maxima prune on every dimension at once.

Ranks come without a global sort: counts of cells (at most 2**(3*BITS)) and of sub-buckets are summed up, and only
rows of one (cell, sub-bucket) are ordered, so that a cell with a third of all rows is spread over many tasks.

Defined results: null text is empty, null metadata lies in the first cell, repeated rows keep rows of their own, an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.numbering import numbered

from .common import cut, quoted

BITS, DIMS = 5, 3


def _walk(n: int) -> tuple[list[int], list[int]]:
    """For state (entry, direction) and the cell's n bits: its place on the curve and the next state."""
    mask = (1 << n) - 1
    left = lambda x, r: ((x << r % n) | (x >> (n - r % n))) & mask
    right = lambda x, r: left(x, n - r % n)
    gray = lambda i: i ^ (i >> 1)
    ungray = {gray(i): i for i in range(1 << n)}
    trailing = lambda i: ((i ^ (i + 1)).bit_length() - 1) % n
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else trailing(w - 1) if w % 2 == 0 else trailing(w)
    place, follow = [], []
    for state in range(n << n):
        e, d = divmod(state, n)
        for cell in range(1 << n):
            w = ungray[right(cell ^ e, d + 1)]
            place.append(w)
            follow.append((e ^ left(entry(w), d + 1)) * n + (d + turn(w) + 1) % n)
    return place, follow


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point whose coordinates are integers of so many bits."""
    n = len(cells)
    place, follow = (F.array(*[F.lit(x) for x in t]) for t in _walk(n))

    def step(acc: Column, b: Column) -> Column:
        cell = sum((F.expr("0"), *[(F.call_function("getbit", c.cast("long"), b).cast("int") * (1 << i)) for i, c in enumerate(cells)]))
        at = (acc["s"] * (1 << n) + cell).cast("int")
        return F.struct((acc["h"] * (1 << n) + F.get(place, at)).cast("long").alias("h"), F.get(follow, at).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    return F.aggregate(F.array(*[F.lit(b) for b in reversed(range(bits))]), start, step)["h"]


def split_values(rows: DataFrame, col: str, cells: int) -> list[str]:
    """At most cells - 1 values that cut a column's distinct values into runs of equal length, as far as they go."""
    values = numbered(rows.select(F.col(col).alias("v")).filter("v is not null").distinct(), ["v"])
    m = values.agg(F.max("place")).first()[0] or 0
    wanted = sorted({i * m // cells + 1 for i in range(1, cells)} - {1})
    return [r["v"] for r in values.filter(F.col("place").isin(wanted)).orderBy("place").collect()] if wanted else []


def cell_of(col: Column, splits: list[str]) -> Column:
    """How many of the split values a value reaches; null is in cell 0."""
    return sum((F.when(col >= F.lit(v), 1).otherwise(0) for v in splits), F.lit(0)).cast("int")


def curve_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, lang_cell, source_cell, size_cell)."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(quoted(lang_col)).cast("string").alias("a"), F.col(quoted(source_col)).cast("string").alias("b"))
    base = cut(base, "curve")
    n = base.count()
    a, b = (cell_of(F.col(c), split_values(base, c, 1 << bits)) for c in ("a", "b"))
    doubling = F.least(F.floor(F.log2(F.col("size").cast("double"))), F.lit((1 << bits) - 1)).cast("int")
    # Ties within a cell are dealt to so many sub-buckets; the order of ties is free, as long as it is fixed.
    buckets = max(8, min(4096, n // 1024))
    base = base.select("doc_id", "size", "text_crc32", a.alias("lang_cell"), b.alias("source_cell"), doubling.alias("size_cell"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("sub"))
    base = base.withColumn("curve", hilbert_index([F.col("lang_cell"), F.col("source_cell"), F.col("size_cell")], bits))
    counts = base.groupBy("curve", "sub").agg(F.count("*").alias("c"))
    before = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.groupBy("curve").agg(F.sum("c").alias("c"))  # at most 2**(3*bits) rows
    cells = cells.select("curve", before(Window.orderBy("curve")).alias("ahead"))
    subs = counts.select("curve", "sub", before(Window.partitionBy("curve").orderBy("sub")).alias("within")).join(cells, "curve")
    subs = subs.select("curve", "sub", (F.col("ahead") + F.col("within")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("curve", "sub").orderBy("doc_id", "text_crc32", "size"))
    ranked = base.join(subs, ["curve", "sub"]).withColumn("rank", F.col("ahead") + place - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(n, 1)}L as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", "lang_cell", "source_cell", "size_cell")


def zone_map(sharded: DataFrame) -> DataFrame:
    """Minima and maxima of each shard's cells, by which readers skip shards."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{c}_{w}") for c in ("lang_cell", "source_cell", "size_cell") for f, w in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
