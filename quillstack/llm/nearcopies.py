"""Near copies: covering simhash links, checked by exact Jaccard similarity of word shingles, and a self-join with prefix filter for the rest.

Texts whose fingerprints lie within the radius meet by op3's covering masks. Similar texts whose fingerprints lie further apart meet by
prefixes, so that none is missed. Either way a pair counts only once its similarity has been verified.

Two sets with a similarity of 4/5 or more share one of the first n - ceil(4n/5) + 1 elements of either, under any
order of all shingles, and after the first of them that they share, both have at least as many elements left as they
must share. Texts therefore meet in buckets by these elements and no such pair is missed. The order puts
what is frequent in a sample last, the sample being a fixed share of the rows, so that a bucket's size does not grow with
them; the sample decides on the size of buckets only, never on the result.

Small buckets propose their pairs. In large ones, which many copies of one text make, each text is proposed to the first
and to the one before it only. Once what is similar has been linked, large buckets propose to each row its nearest ones of other
components, in rounds while that links any, and at last all pairs that still lie in different components, so that no
link between components is missed and no group's pairs are all made. Proposed pairs are dropped where BITS parities of their sets differ in more places than similar sets may differ in elements; the
others are verified on their texts.

Defined results: words as in simhash; a text of fewer than five words is one shingle; texts of equal shingles, those
without words too, are copies. Shingles are compared by 64-bit hashes. Rows with a null id carry their component
but never name it. Repeated rows stay rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, cut, discard, may_hold, mix64, sieve, slices, small_batches

WORDS, SEED = 5, 42
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: One of so many rows is sampled for frequent shingles, but SAMPLE rows at least; in how many of them one is frequent.
SHARE, SAMPLE, FREQUENT = 8, 4096, 3
#: Cells of the table that orders shingles, and how many of them may be taken, else only more frequent ones count.
CELLS, TAKEN = 1 << 23, 1 << 21
#: Buckets up to this size emit their pairs.
BUCKET = 32
#: Rows of one bucket that a task looks at together when it proposes pairs along it.
ROWS = 65_536
#: Parities kept of a set, by the hashes' last bits.
BITS = 512
#: Rows of other components that a row is proposed to in one round, and rounds, before all that are left are proposed.
NEAREST, ROUNDS = 2, 4
_P = np.uint64(0x2545F4914F6CDD1D)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not toks:
        return np.empty(0, np.uint64)
    digest, k = xxhash.xxh64_intdigest, min(words, len(toks))
    w = np.fromiter((digest(t, SEED) for t in toks), np.uint64, len(toks))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix64(h * _P + w[i : i + n])
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets reaches PART / WHOLE."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def prefix(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The elements of a set by which it meets all similar ones: the first by the table's level and hash."""
    level = table[(s % np.uint64(len(table))).astype(np.int64)]
    if level.any():
        s = s[np.lexsort((s, level))]
    return s[: len(s) - -(-PART * len(s) // WHOLE) + 1]


def _levels(docs: DataFrame, cells: int = CELLS, taken: int = TAKEN) -> np.ndarray:
    """The order of shingles as a table of fixed size: a hash's cell has the binary logarithm of its count in the sample, 0 where it
    is not frequent there. Hashes that share a cell share a level, which leaves it one order for all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py()) for t in b.column(0)]).view(np.int64))], ["h"])

    share = min(1 << 20, max((1 << 20) // SHARE, -(-SAMPLE * (1 << 20) // max(1, docs.count()))))
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share).select("text")
    # Unsigned: 2^64 is a multiple of the number of cells.
    found = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = cut(found.select(F.pmod("h", F.lit(cells)).cast("int").alias("cell"), F.log2("n").cast("byte").alias("level")).groupBy("cell").agg(F.max("level").alias("level")), "levels")
    sizes = sorted(((r["level"], r["n"]) for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 64, 0  # no level
    for level, n in sizes:
        total += n
        if total > taken:
            break
        least = level
    held = found.filter(F.col("level") >= least).toArrow()  # `taken` rows of 5 bytes at most
    discard(found)
    table = np.zeros(cells, np.uint8)
    table[held.column("cell").to_numpy()] = held.column("level").to_numpy()
    return table


def _may_match(n, at, x, y) -> np.ndarray:
    """Whether sizes allow rows x and y to be similar, and enough elements follow the one that they met by."""
    # (PART + WHOLE) * (elements left) >= PART * (both sizes), for either; the bound on sizes follows from it.
    reach = WHOLE * n - (PART + WHOLE) * at
    return (reach[x] >= PART * n[y]) & (reach[y] >= PART * n[x])


def _values(column: pa.Array) -> np.ndarray:
    """Whole numbers, or parities as rows of 64-bit words."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], columns: int, most: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, in parts that hold whole runs of it. most: a run of more rows comes in
    parts, each but the first with the run's first row and the row before it in front."""
    held, first = None, None
    for b in batches:
        cols = [_values(b.column(i)) for i in range(columns)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
        if last:
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
        if most and len(held[0]) > most:
            yield held
            first = held[0][:1], [c[:1] for c in held]
            held = [np.concatenate([f, c[-1:]]) for f, c in zip(first[1], held)]
    if held is not None and len(held[0]):
        yield held


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, h) of rows (h, n, at, rep) sorted by h, n and rep: pairs proposed by small buckets, with null h, and by large
    ones, with h."""
    for h, n, at, rep in _buckets(batches, 4, ROWS):
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        for m in np.unique(sizes[sizes > 1]):
            own = starts[sizes == m]
            if m <= BUCKET:
                i, j = np.triu_indices(m, 1)
                x, y = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
            else:
                member = np.arange(1, m)
                x = np.r_[np.repeat(own, m - 1), (own[:, None] + member - 1).ravel()]
                y = np.tile((own[:, None] + member).ravel(), 2)
            ok = (rep[x] != rep[y]) & _may_match(n, at, x, y)
            a, b = np.minimum(rep[x[ok]], rep[y[ok]]), np.maximum(rep[x[ok]], rep[y[ok]])
            if m <= BUCKET:
                out = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.nulls(out.shape[1], pa.int32())], ["a", "b", "h"])
            else:
                # A large bucket is told of even where it proposes none.
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[a, rep[own]]), pa.array(np.r_[b, rep[own]]), pa.array(np.r_[h[x[ok]], h[own]].astype(np.int32))], ["a", "b", "h"])


def _across(batches: Iterator[pa.RecordBatch], nearest: int | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (h, n, at, rep, component, parities) sorted by h and n: pairs of a bucket's rows in different components that
    may be similar. nearest: of each row outside the bucket's largest component so many at most, by parities."""
    for h, n, at, rep, comp, bits in _buckets(batches, 6):
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(h)]):
            c = comp[s:e]
            names, index, count = np.unique(c, return_inverse=True, return_counts=True)
            if len(names) == 1:
                continue
            # Two rows of different components: one of them is not of the largest one. Sizes leave each a run of partners,
            # the shorter the later the element by which it met them.
            size, reach, own = n[s:e], WHOLE * n[s:e] - (PART + WHOLE) * at[s:e], bits[s:e]
            u = np.flatnonzero(index != count.argmax())
            lo = np.searchsorted(size, -(-PART * size[u] // WHOLE))
            many = np.maximum(np.searchsorted(size, reach[u] // PART, "right") - lo, 0)
            ends = np.cumsum(many)
            k = 0
            while k < len(u):
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + 200_000, "right")))
                each = many[k:stop]
                x = np.repeat(u[k:stop], each)
                y = np.arange(each.sum()) + np.repeat(lo[k:stop] - np.r_[0, np.cumsum(each)[:-1]], each)
                ok = (index[x] != index[y]) & (reach[y] >= PART * size[x])
                x, y = x[ok], y[ok]
                apart = np.bitwise_count(own[x] ^ own[y]).sum(1, dtype=np.int64)
                ok = (WHOLE + PART) * apart <= (WHOLE - PART) * (size[x] + size[y])
                x, y = x[ok], y[ok]
                if nearest is not None and len(x):
                    order = np.lexsort((apart[ok], x))
                    x, y = x[order], y[order]
                    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    ok = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) < nearest
                    x, y = x[ok], y[ok]
                a, b = rep[s + x], rep[s + y]
                out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])
                k = stop


def parities(s: np.ndarray) -> bytes:
    """BITS parities of a set; those of two sets differ in no more places than the sets have elements not in common."""
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those (a, b) of rows (a, b, n, parities of a, parities of b), n being both sizes' sum, that may be similar."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BITS // 8) for i in (3, 4))
        n = batch.column(2).to_numpy(zero_copy_only=False)
        keep = pa.array((WHOLE + PART) * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (WHOLE - PART) * n)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those (a, b) of rows (a, b, text of a, text of b) that are similar."""
    last, own = None, None
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            s = s.as_py()
            if s != last:
                last, own = s, shingles(s)
            if similar(own, shingles(t.as_py())):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def dropped_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th) of the rows to drop, th being the text's xxhash64: of each group of near copies all documents but
    that of the smallest id and, of those, the smallest hash. Rows that repeat id and text are one document. Rows of a null
    id are kept."""
    rows = near_copies(docs, True).filter("doc_id is not null")
    # Named by the shingles first, so that a group of many copies is summed up before it meets.
    best = rows.groupBy("component_id", "sig").agg(F.min(F.struct("doc_id", "th")).alias("m")).groupBy("component_id").agg(F.min("m").alias("m"))
    return rows.join(best, "component_id").filter("doc_id <> m.doc_id or th <> m.th").select("doc_id", "th").distinct()


def near_copies(docs: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, component_id) of docs(doc_id, text), one row per input row: the smallest id that similar pairs lead to.
    rows: with `th`, the text's xxhash64, and `sig`, a hash of its shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    table = _levels(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t.as_py()) for t in b.column(2)]
            sig = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            # 32 bits tell buckets apart; sets that meet in one by chance are told apart later.
            heads = [(prefix(s, table) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            fps = np.array([simhash.fingerprint(t.as_py(), WORDS) for t in b.column(2)], np.uint64)
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([parities(s) for s in sets], pa.binary()), pa.array(fps.view(np.int64))], ["doc_id", "th", "sig", "n", "heads", "bits", "fp"])

    own = cut(docs.mapInArrow(run, "doc_id long, th long, sig long, n long, heads array<int>, bits binary, fp long"), "shingles")
    # One row for all texts of equal shingles, known by their hash; the first of them lends its text.
    sets = own.filter("doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th", "n", "heads", "bits", "fp")).alias("r"))
    # Written numbers of the sets are short keys for all that follows.
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rep"), "sig", F.col("r.doc_id").alias("doc"), F.col("r.th").alias("rth"), "r.n", "r.heads", "r.bits", "r.fp"), "shingles")
    heads = sets.select(F.posexplode("heads").alias("at", "h"), F.col("n").cast("int").alias("n"), "rep").select("h", "n", "at", "rep")
    met = cut(heads.repartition("h").sortWithinPartitions("h", "n", "rep").mapInArrow(_met, "a long, b long, h int"), "met")
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def possible(proposed: DataFrame) -> DataFrame:
        both = proposed.filter("a <> b").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        return cut(both.select("a", "b", F.col("na") + F.col("nb"), "bitsa", "bitsb").mapInArrow(_possible, "a long, b long"), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        """Written with the texts of both, an Arrow batch of few at a time."""
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        asked = cut(ends.join(sets.select("rep", "doc", "rth"), "rep"), "asked")
        wanted = may_hold(docs, F.xxhash64("doc_id", "th"), sieve(asked.select(F.xxhash64("doc", "rth").alias("k")))).filter("maybe")
        texts = cut(wanted.join(asked, (F.col("doc_id") == F.col("doc")) & F.col("th").eqNullSafe(F.col("rth"))).select("rep", "text"), "texts")
        both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t")), "b")
        with small_batches(docs.sparkSession):
            found = cut(both.select("a", "b", "s", "t").mapInArrow(_verified, "a long, b long"), "links")
        discard(texts, asked, pairs)
        return found

    named = lambda edges: components(edges).select(F.col("node").alias("rep"), "component")
    # Stars of the masks' clusters, and every set with the one that stands for its fingerprint.
    fps = cut(sets.groupBy("fp").agg(F.min("rep").alias("rep")), "fps")
    stars = simhash.links(fps).union(sets.select("fp", F.col("rep").alias("a")).join(fps.withColumnRenamed("rep", "b"), "fp").select("a", "b"))
    found = verified(possible(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(met.select("a", "b"))))
    comp = named(found)
    # What large buckets have not proposed yet: pairs of different components. Each row meets its nearest ones first, so that
    # components grow together before all pairs across them are made.
    large = cut(met.filter("h is not null").select("h").distinct(), "large")
    left = cut(heads.join(large, "h", "left_semi").join(sets.select("rep", "bits"), "rep"), "left")
    discard(met, large)

    def across(nearest: int | None) -> DataFrame:
        rows_left = left.join(comp, "rep", "left").select("h", "n", "at", "rep", F.coalesce("component", "rep").alias("component"), "bits")
        pairs = rows_left.repartition("h").sortWithinPartitions("h", "n", "rep").mapInArrow(lambda batches: _across(batches, nearest), "a long, b long")
        return cut(pairs.distinct(), "pairs")

    rounds = [None] + [NEAREST] * ROUNDS  # taken from the end
    while rounds:
        nearest = rounds.pop()
        more = across(nearest)
        if more.isEmpty():  # nothing is left across components
            break
        more = verified(more)
        if more.isEmpty():
            rounds = rounds[:1] if nearest else []
        else:
            found = found.union(more)
            comp = named(found)
    name = sets.select("sig", "rep", "doc").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = name.groupBy("component").agg(F.min("doc").alias("component_id"))
    out = own.join(name.join(least, "component").select("sig", "component_id"), "sig", "left")
    return out.select("doc_id", "component_id", *["th", "sig"] * rows)
