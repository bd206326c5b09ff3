"""A stored index of three-character grams: substring search by reading a few grams' files and the rows that these leave.

The folder holds, by epoch (one for each change):

    postings/epoch=E/bucket=B   gram, block, at         the places, within a block of rows, of those that hold a gram (lower case), by gram within a bucket
    rows/epoch=E                id, d, low, live, place a row put in or taken out, once: its number of grams, its text in lower case, and where it stands
    grams/epoch=E               gram, bucket, n         the grams there are and the rows of each: for queries shorter than one, and to begin with the rarest
    totals/epoch=E              n, total                rows alive after this epoch, and their grams

Rows stand in blocks of a bounded number (place div BLOCK), so that postings are few and short, and a search brings a block's texts and postings
together once for all terms. The two rarest of a term's grams say which rows may hold it; its occurrences are counted in the texts of these
rows. Where in a text a gram stands is not kept: that would take several times the text. A search reads the buckets of its grams (partitions), and in them the row groups that hold them.
A later epoch's row hides an earlier one's postings. An epoch is written whole, so one that runs again replaces itself; compact() makes
one of all. Postings are written in passes, so that one pass's share of them is shuffled at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions.scalars import query_terms, strip_all
from quillstack.operators.search import DIGITS, FETCH, K1, B
from quillstack.sources.shared import cut, epochs, shuffles_end

GRAM = 3
#: Buckets of grams; rows of one file of a bucket, about; grams that a query may list as literals.
BUCKETS, FILE_ROWS, LISTED = 64, 1 << 20, 2048
#: Rows of a block; characters whose grams are sorted together, about; terms that meet a block's texts at once.
BLOCK, CHARS, ASKED = 512, 1 << 22, 4096
#: How postings are written: places as packed differences.
DENSE = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
#: A term's grams that are looked up: its rarest.
RAREST = 2
#: Passes in which postings are written, where there are more grams than these: what one pass shuffles is less than the texts.
PASSES, ONE_PASS = 4, 1 << 34


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, part: int = 0, of: int = 1) -> DataFrame:
    """(gram, block, at) of rows(place, low): where in its block the rows are that hold a gram, each once, of the given part of all grams.
    A block that a task reads in pieces has several such lists, of other rows."""

    def grams(block: int, at: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if len(chars) < GRAM:
            return
        there = np.zeros(int(chars.max()) + 1, bool)
        there[chars] = True
        letters = np.flatnonzero(there).astype(np.int64)
        n, m = len(letters), len(texts)
        if m > 1 and n**GRAM * m >= 1 << 63:
            for i in range(m):
                yield from grams(block, at[i : i + 1], texts[i : i + 1])
            return
        number = np.zeros(len(there), np.int64)
        number[letters] = np.arange(n)
        c = number[chars]
        size = np.fromiter(map(len, texts), np.int64, m)
        row = np.repeat(np.arange(m), size)
        own = (row[2:] == row[:-2])  # within one text
        key = (((c[:-2] * n + c[1:-1]) * n + c[2:]) * m + row[:-2])[own]
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        code, row = key // m, key % m
        if of > 1:
            whole = letters[code // (n * n)] << 42 | letters[code // n % n] << 21 | letters[code % n]
            own = (whole.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(of) == part
            code, row = code[own], row[own]
        if not len(code):
            return
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        head = code[first]
        joined = np.stack([letters[head // (n * n)], letters[head // n % n], letters[head % n]], 1).astype(np.uint32).tobytes().decode("utf-32-le")
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(at[row], pa.int16()))
        yield pa.RecordBatch.from_arrays([pa.array([joined[i : i + GRAM] for i in range(0, len(joined), GRAM)], pa.string()), pa.array(np.full(len(first), block)), lists], ["gram", "block", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy(zero_copy_only=False)
            # A slice ends with its block, or where it has so many characters.
            upto = np.cumsum(pc.utf8_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(place):
                end = i + int(np.argmax(np.append(place[i : i + BLOCK] // BLOCK != place[i] // BLOCK, True)))
                end = min(end, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHARS, "right"))))
                yield from grams(int(place[i]) // BLOCK, place[i:end] % BLOCK, b.column(1).slice(i, end - i).to_pylist())
                i = end

    return rows.select("place", "low").mapInArrow(run, "gram string, block long, at array<smallint>")


def counted(key: tuple, found: pa.Table, texts: pa.Table) -> pa.Table:
    """(epoch, block, term, ids, ds, ns): how often the texts of a block, texts(at, id, d, low), hold terms; found(term, parts, over, at) says for each
    of a term's grams that is looked up which rows hold it."""
    if not found.num_rows or not texts.num_rows:
        return pa.table([pa.array([], t) for t in LISTS.values()], list(LISTS))
    found, texts = found.combine_chunks(), texts.combine_chunks()
    coded = found["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    parts, over = np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    parts[code], over[code] = found["parts"].to_numpy(), found["over"].to_numpy(zero_copy_only=False)
    lists = found["at"].combine_chunks()
    at = lists.flatten().to_numpy().astype(np.int64)
    hits = np.bincount(np.repeat(code, pc.list_value_length(lists).to_numpy()).astype(np.int64) * BLOCK + at, minlength=len(terms) * BLOCK)
    row = np.full(BLOCK, -1)
    row[texts["at"].to_numpy()] = np.arange(texts.num_rows)
    t, at = np.nonzero((hits.reshape(-1, BLOCK) == parts[:, None]) & (row >= 0))
    row, low, names = row[at], texts["low"].combine_chunks().cast(pa.binary()).to_pylist(), [x.encode() for x in terms.to_pylist()]
    n = np.zeros(len(t), np.int32)
    ends = np.searchsorted(t, np.arange(len(names) + 1))
    for k, name in enumerate(names):
        own = row[ends[k] : ends[k + 1]].tolist()
        n[ends[k] : ends[k + 1]] = [_overlapping(low[i], name) for i in own] if over[k] else [low[i].count(name) for i in own]
    t, row, n = t[n > 0], row[n > 0], n[n > 0]
    held = np.unique(t)
    offsets = pa.array(np.append(np.searchsorted(t, held), len(t)), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    own = [pa.array([key[i].as_py()] * len(held), LISTS[c]) for i, c in enumerate(("epoch", "block"))]
    ids, ds = (texts[c].combine_chunks().take(pa.array(row)) for c in ("id", "d"))
    return pa.table([*own, terms.take(pa.array(held)).cast(pa.string()), listed(ids), listed(ds), listed(pa.array(n))], list(LISTS))


FOUND = "epoch int, block long, term string, ids array<long>, ds array<int>, ns array<int>"
LISTS = {"epoch": pa.int32(), "block": pa.int64(), "term": pa.string(), "ids": pa.list_(pa.int64()), "ds": pa.list_(pa.int32()), "ns": pa.list_(pa.int32())}


def scored(by: list[str], k: int, rows: pa.Table) -> pa.Table:
    """(by..., id, score): the k best rows of a block for each query, and those whose score may be rounded to theirs. rows(by..., t, idf, mean, ids, ds, ns)."""
    rows = rows.combine_chunks()
    t, idf, mean = (rows[c].to_numpy() for c in ("t", "idf", "mean"))
    start = np.append(0, np.cumsum(pc.list_value_length(rows["ids"].combine_chunks()).to_numpy()))
    ids, d, n = (rows[c].combine_chunks().flatten().to_numpy() for c in ("ids", "ds", "ns"))
    queries: dict[tuple, list[int]] = {}
    for i, q in enumerate(zip(*(rows[c].to_pylist() for c in by))):
        queries.setdefault(q, []).append(i)
    owner, found, scores = [], [], []
    for own in queries.values():
        own.sort(key=t.__getitem__)  # a query's terms, in order
        places = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
        held, at = np.unique(ids[places], return_inverse=True)
        total, done = np.zeros(len(held)), 0
        for i in own:
            here = slice(start[i], start[i + 1])
            total[at[done : done + start[i + 1] - start[i]]] += idf[i] * n[here] * (K1 + 1) / (n[here] + K1 * (1 - B + B * d[here] / mean[i]))
            done += start[i + 1] - start[i]
        if len(held) > k:
            good = total >= np.partition(total, len(total) - k)[len(total) - k] - 2 * 10.0**-DIGITS
            held, total = held[good], total[good]
        owner.append(np.full(len(held), own[0]))
        found.append(held)
        scores.append(total)
    whose = pa.array(np.concatenate(owner))
    return pa.table([*(rows[c].combine_chunks().take(whose) for c in by), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))], [*by, "id", "score"])


def _overlapping(text: bytes, term: bytes) -> int:
    n, i = 0, text.find(term)
    while i >= 0:
        n, i = n + 1, text.find(term, i + 1)
    return n


def _length(text: Column) -> Column:
    return F.greatest(F.length(F.coalesce(text, F.lit(""))) - (GRAM - 1), F.lit(0)).cast("int")


class GramIndex:
    """An index in a folder. Ids are longs, one row each within an epoch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS) -> GramIndex:
        index = cls(rows.sparkSession, path, buckets)
        index.apply(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), 0)
        return index

    # ---- writing

    def apply(self, changes: DataFrame, epoch: int, removed: DataFrame | None = None) -> None:
        """Put changes(id, text) in, in place of rows of the same ids, and take removed(id) out, as one epoch. Run again, it
        replaces what it wrote before. Only the changes' own postings are written."""
        rows = changes.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        own = rows.select("id", _length(F.col("text")).alias("d"), F.lower("text").alias("low"), F.lit(True).alias("live"))
        if removed is not None:
            gone = removed.select(F.col("id").cast("long").alias("id")).join(own.select("id"), "id", "left_anti")
            own = own.unionByName(gone.select("id", F.lit(0).alias("d"), F.lit(None).cast("string").alias("low"), F.lit(False).alias("live")))
        self._write_rows(own, epoch)
        self._write(self._totals(epoch), "totals", epoch)

    def _write_rows(self, own: DataFrame, epoch: int) -> None:
        """Rows (id, d, low, live) as an epoch, where they come to stand, and the postings of their texts in passes: the first replaces what
        there was, the others add to it."""
        self._write(own.withColumn("place", F.monotonically_increasing_id()), "rows", epoch)
        rows = self._read("rows", epoch)
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
        # A bucket with a very common gram goes to several files.
        files, passes = max(1, -(-n // FILE_ROWS)), PASSES if total > ONE_PASS else 1
        for k in range(passes):
            found = postings(rows.filter("live"), k, passes).withColumn("bucket", bucket_of(F.col("gram"), self.buckets))
            found = found.repartition(self.buckets * files, "bucket", F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions("bucket", "gram", "block")
            with shuffles_end(self.spark):
                found.write.mode("append" if k else "overwrite").options(**DENSE).partitionBy("bucket").parquet(f"{self.path}/postings/epoch={epoch}")
        self._write(self._read("postings", epoch).groupBy("gram", "bucket").agg(F.sum(F.size("at")).alias("n")), "grams", epoch)

    def _totals(self, epoch: int) -> DataFrame:
        """Rows alive and their grams: those of the epoch before, with what this one's ids change."""
        now = self._read("rows", epoch)
        own = now.agg(F.count_if("live").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("total"))
        before = [e for e in self.epochs() if e < epoch]
        if not before:
            return own
        old = self._last(self._read("rows", *before).join(now.select("id"), "id", "left_semi"))
        old = old.agg(F.count_if("live").alias("n0"), F.coalesce(F.sum("d"), F.lit(0)).alias("total0"))
        last = self._read("totals", before[-1]).select(F.col("n").alias("n1"), F.col("total").alias("total1"))
        return own.crossJoin(old).crossJoin(last).select((F.expr("n + n1 - n0")).alias("n"), F.expr("total + total1 - total0").alias("total"))  # one row each

    def compact(self, path: str) -> GramIndex:
        """The index in one epoch, in another folder: what later epochs hide is left out."""
        out = GramIndex(self.spark, path, self.buckets)
        last = self._last(self._read("rows")).filter("live").select("id", "epoch")
        out._write_rows(self._read("rows").join(last, ["id", "epoch"]).select("id", "d", "low", "live"), 0)
        out._write(out._read("rows", 0).agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("total")), "totals", 0)
        return out

    def _write(self, df: DataFrame, part: str, epoch: int) -> None:
        with shuffles_end(self.spark):
            df.write.mode("overwrite").options(**DENSE).parquet(f"{self.path}/{part}/epoch={epoch}")

    # ---- reading

    _SCHEMA = {
        "postings": "gram string, block long, at array<smallint>, epoch int, bucket int", "rows": "id long, d int, low string, live boolean, place long, epoch int", "grams": "gram string, bucket int, n long, epoch int",
        "totals": "n long, total long, epoch int",
    }

    def epochs(self) -> list[int]:
        return epochs(self.spark, f"{self.path}/rows")

    def _read(self, part: str, *of: int) -> DataFrame:
        df = self.spark.read.schema(self._SCHEMA[part]).option("basePath", f"{self.path}/{part}")
        return df.parquet(*[f"{self.path}/{part}/epoch={e}" for e in of]) if of else df.parquet(f"{self.path}/{part}")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """Each id's row of its last epoch."""
        got = rows.groupBy("id").agg(F.max_by(F.struct("d", "live"), "epoch").alias("r"), F.max("epoch").alias("epoch"))
        return got.select("id", "r.*", "epoch")

    def _live(self, hits: DataFrame) -> DataFrame:
        """Rows (id, epoch, ...) without those that a later epoch has put in anew or taken out."""
        every = self.epochs()
        if len(every) < 2:
            return hits
        later = self._read("rows", *every[1:]).groupBy("id").agg(F.max("epoch").alias("last"))
        return hits.join(later, "id", "left").filter(F.col("last").isNull() | (F.col("epoch") >= F.col("last"))).drop("last")

    def totals(self) -> DataFrame:
        """(rows, mean): how many rows there are, and the mean number of grams of one. One row."""
        return self._read("totals", self.epochs()[-1]).select(F.col("n").alias("rows"), F.try_divide("total", "n").alias("mean"))

    def _found(self, need: DataFrame) -> DataFrame:
        """Postings of need's grams (bucket, gram, ...). Buckets and grams that are few enough to list reach the scan as literals."""
        rows = self._read("postings")
        listed = need.select("gram", "bucket").distinct().limit(LISTED + 1).collect()
        if len(listed) <= LISTED:  # else the join alone selects
            rows = rows.filter(F.col("bucket").isin(sorted({r["bucket"] for r in listed})) & F.col("gram").isin(sorted(r["gram"] for r in listed)))
        return rows.join(need, ["bucket", "gram"])

    def occurrences(self, asked: DataFrame, by: Sequence[str] = ("q",)) -> DataFrame:
        """(by..., t, id, d, n): how often a row holds a term, overlaps counted. asked(by..., t, term): terms of three characters and
        more; a term is told by `by` and t."""
        asked = asked.select(*by, "t", F.lower("term").alias("term"))
        return self._each(asked, self._lists(asked), by)

    @staticmethod
    def _each(asked: DataFrame, lists: DataFrame, by: Sequence[str]) -> DataFrame:
        """(by..., t, id, d, n) of terms' lists."""
        rows = asked.join(lists, "term").select(*by, "t", F.explode(F.arrays_zip("ids", "ds", "ns")).alias("x"))
        return rows.select(*by, "t", F.col("x.ids").alias("id"), F.col("x.ds").alias("d"), F.col("x.ns").cast("long").alias("n"))

    def _lists(self, asked: DataFrame) -> DataFrame:
        """(epoch, block, term, ids, ds, ns): of every term asked, by block, the rows that hold it, with lengths and numbers of occurrences. asked(term, ...)
        in lower case."""
        # A term that many queries ask is looked up once.
        places = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("last"), F.lit(GRAM)), F.array("last")))
        need = asked.select("term").distinct().withColumn("chars", F.split("term", "")).withColumn("last", F.size("chars") - GRAM).filter("last >= 0").withColumn("places", places)
        need = need.select("term", F.explode("places").alias("off"), "chars").select("term", "off", F.array_join(F.slice("chars", F.col("off") + 1, GRAM), "").alias("gram"))
        need = need.groupBy("term", "gram").agg(F.min("off").alias("off")).withColumn("bucket", bucket_of(F.col("gram"), self.buckets))
        # Its rarest grams say which rows may hold it; their texts say how often.
        known = self._read("grams").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        rarest = Window.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "off")
        need = need.join(known, ["bucket", "gram"], "left").withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= RAREST)
        # Occurrences overlap only where a term ends as it begins.
        over = F.exists(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.left("term", i) == F.right("term", i))
        need = cut(need.withColumn("parts", F.count("*").over(Window.partitionBy("term"))).select("term", "parts", over.alias("over"), "bucket", "gram"), "need")
        # A block's texts and postings meet once, or once for each so many terms.
        terms = need.select("term").distinct().count()
        if not terms:
            return self.spark.createDataFrame([], FOUND)
        split = -(-terms // ASKED)
        maybe = self._found(need).select("epoch", "block", F.pmod(F.xxhash64("term"), F.lit(split)).alias("part"), "term", "parts", "over", "at")
        texts = self._live(self._read("rows").filter("live").select("id", "epoch", "place", "d", "low")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(split - 1).cast("long"))))
        texts = texts.select("epoch", F.expr(f"place div {BLOCK}").alias("block"), "part", F.expr(f"place % {BLOCK}").alias("at"), "id", "d", "low")
        at = ("epoch", "block", "part")
        return maybe.groupBy(*at).cogroup(texts.groupBy(*at)).applyInArrow(counted, FOUND)

    def scores(self, hits: DataFrame, by: Sequence[str] = ("q",), allowed: DataFrame | None = None) -> DataFrame:
        """(by..., id, score): BM25 from occurrences(). allowed(by..., id) restricts rows, not corpus numbers."""
        return self._scores(hits, hits.groupBy(*by, "t").agg(F.count("*").alias("df")), list(by), allowed)

    def _weights(self, known: DataFrame) -> DataFrame:
        """known(..., df) with the weight of a term that so many rows hold, and the mean length of rows."""
        idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return known.crossJoin(F.broadcast(self.totals())).withColumn("idf", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)).drop("rows", "df")  # one row of corpus numbers

    def _scores(self, hits: DataFrame, known: DataFrame, by: list[str], allowed: DataFrame | None) -> DataFrame:
        if allowed is not None:
            hits = hits.join(allowed, [*by, "id"], "left_semi")
        x = hits.join(self._weights(known), [*by, "t"])
        part = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("d") / F.col("mean")))
        parts = x.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct("t", part.alias("p")))).alias("parts"))  # a query's terms, in order
        return parts.select(*by, "id", F.round(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["p"]), DIGITS).alias("score"))

    def _best(self, asked: DataFrame, lists: DataFrame, known: DataFrame, by: list[str], k: int) -> DataFrame:
        """(by..., id, score): each query's k best rows of every block, and others."""
        split = max(1, -(-asked.select(*by).distinct().count() // ASKED))
        rows = self._weights(asked.join(known, "term")).join(lists, "term").withColumn("part", F.pmod(F.xxhash64(*by), F.lit(split)))
        kinds = dict(asked.dtypes)
        best = rows.select("epoch", "block", "part", *by, "t", "idf", "mean", "ids", "ds", "ns").groupBy("epoch", "block", "part").applyInArrow(lambda x: scored(by, k, x), ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", id long, score double")
        return best.withColumn("score", F.round("score", DIGITS))

    def containing(self, asked: DataFrame, by: Sequence[str] = ("q",)) -> DataFrame:
        """(by..., id): rows that contain a text, of any length from one character on. asked(by..., text)."""
        by = list(by)
        low = asked.select(*by, F.lower("text").alias("text"))
        long = self.occurrences(low.filter(F.length("text") >= GRAM).select(*by, F.lit(0).alias("t"), F.col("text").alias("term")), by).select(*by, "id")
        short = low.filter(F.length("text").between(1, GRAM - 1))
        if short.isEmpty():
            return long
        pieces = lambda c: F.array_distinct(F.filter(F.array(*[F.substring(c, i, n) for n in range(1, GRAM) for i in range(1, GRAM + 2 - n)]), lambda x: x != ""))
        grams = self._read("grams").select("gram", "bucket").distinct().withColumn("text", F.explode(pieces("gram"))).join(short, "text").select(*by, "gram", "bucket")
        inside = self._found(grams).select(*by, "epoch", "block", F.explode("at").alias("at")).withColumn("place", F.expr(f"block * {BLOCK} + at"))
        inside = inside.join(self._read("rows").select("id", "epoch", "place"), ["epoch", "place"]).select(*by, "id", "epoch")
        ends = self._read("rows").filter(f"length(low) between 1 and {GRAM - 1}").select("id", "epoch", F.explode(pieces("low")).alias("text")).join(short, "text").select(*by, "id", "epoch")
        return long.unionByName(self._live(inside.unionByName(ends).distinct()).select(*by, "id"))

    def topk(self, queries: DataFrame, by: Sequence[str] = ("q",), k: int = FETCH, whole: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """(by..., id, score, rank), written: the k best rows of every query, by its terms or as one phrase; where these have no
        hit, the first k rows, by id, that contain the query's text, with score 0. queries(by..., text); an empty text has none."""
        by = list(by)
        asked = queries.select(*by, strip_all("text").alias("text"))
        terms = F.array("text") if whole else query_terms("text")
        named = asked.select(*by, F.posexplode(terms).alias("t", "term")).withColumn("term", F.lower("term"))
        lists = cut(self._lists(named), "found")
        known = lists.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
        if allowed is None:
            rows = self._best(named, lists, known, by, k)
        else:
            rows = self._scores(self._each(named, lists, by), named.join(known, "term").select(*by, "t", "df"), by, allowed)
        best = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        first = cut(rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first")
        other = self.containing(asked.join(first.select(*by).distinct(), by, "left_anti"), by)
        if allowed is not None:
            other = other.join(allowed, [*by, "id"], "left_semi")
        other = other.select(*by, "id", F.lit(0.0).alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return first.unionByName(other)
