"""How far sources of a language differ in their words: exact sums over all pairs of sources, heavy and light terms apart.

A term is heavy if more than `light` sources of its language say it. Heavy terms stand in dense tiles: for a block of terms, an
array of shares by term and source, absent sources with the share of a count of zero; two tiles of sources give all their pairs by
array arithmetic. A light term would leave such an array nearly all background, so for it the sum starts from the background of every
pair (all light terms at a count of zero) and is corrected: once for each source's terms against every other's background, by the
histogram of its shares, and once for each two sources that both say the term, from its posting list of at most `light` entries. All
of it is done in whole numbers, so the partial sums add up to the exact value.

    value(g, h) = sum over heavy of f(g, h) + n_light * f(g0, h0) + sum over light of g of (f(g, h0) - f(g0, h0)) + the same for h
                  + sum over light of both of (f(g, h) - f(g, h0) - f(g0, h) + f(g0, h0))

Defined results: null text, language and source are the empty string, repeated rows are documents of their own, sources without terms have
a row against every other source of their language, an empty table gives no rows, other columns are not read, texts and terms may be
of any length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, quoted, slices

#: Documents of a language that a kept term is in, at least; terms reported for each source; the whole that shares are parts of.
MIN_DOCS, TOP, WHOLE = 10, 10, 1_000_000_000
#: A term that more sources of its language say is heavy. Sources of a tile, heavy terms of a block.
LIGHT, TILE, BLOCK = 8, 128, 1024
#: Different terms that a task counts before it sends them on.
HELD = 1 << 17
#: Byte by byte: A-Z to lower case, letters and bytes above ASCII as they are, all else a blank.
_AS_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, count, docs): how often a group says a term, and in how many of its documents. Every group has one more
    row of the empty term, with a count of zero and the number of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, str], Counter] = defaultdict(Counter)
        within: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in within.items():
                said = count[lang, source]
                names = list(terms)
                cols = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string()), pa.array([said[t] for t in names], pa.int64()), pa.array(list(terms.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "count", "docs"])
            count.clear()
            within.clear()

        for b in slices(batches):
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = Counter(text.translate(_AS_TERMS).split())
                count[lang, source].update(words)
                inside = within[lang, source]
                inside.update(words.keys())
                inside[b""] += 1
            if sum(map(len, within.values())) > HELD:
                yield from sent()
        yield from sent()

    said = lambda c: F.coalesce(F.col(quoted(c)).cast("string"), F.lit(""))
    rows = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(WHOLE * (count + 2) / (total + 2 * kinds)), in whole numbers of any size; a language without kept terms has 1."""
    over, under = f"cast({WHOLE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))", f"cast({total} + 2 * {kinds} as decimal(20,0))"
    return F.when(F.expr(kinds) > 0, 1 + F.expr(f"{over} div {under}")).otherwise(1).cast("long")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)). Shares are at most WHOLE + 1, so squares fit 64 bits."""
    d = p - q
    return d * d // (p + q)


def _tile_sums(rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Sums over one block of heavy terms, and over what light terms owe the background, for the pairs of two tiles of sources.

    Rows by kind: 0 sources (rank, share of zero, light terms where this block counts them, else 0), 1 heavy postings (rank, share, term),
    2 histograms of light shares (rank, share, how many). With one tile against itself each pair comes once.
    """
    lang, a, b = rows["lang"].iloc[0], int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    kind = [rows[rows["kind"] == k] for k in range(3)]
    sources = kind[0].sort_values("rank")
    rank, zero = sources["rank"].to_numpy(np.int64), sources["share"].to_numpy(np.int64)
    left, right = rank // tile == a, rank // tile == b
    ground = _apart(zero[left][:, None], zero[right][None, :])
    total = ground * int(sources["n"].max())
    place = pd.Series(np.arange(len(rank)), rank)
    if len(kind[1]):
        term, names = pd.factorize(kind[1]["term"])
        shares = np.tile(zero, (len(names), 1))
        shares[term, place[kind[1]["rank"]].to_numpy()] = kind[1]["share"].to_numpy(np.int64)
        step = max(1, (1 << 21) // max(1, ground.size))
        for at in range(0, len(names), step):
            part = shares[at : at + step]
            total += _apart(part[:, left][:, :, None], part[:, right][:, None, :]).sum(axis=0)
    if len(kind[2]):
        owner, share, n = place[kind[2]["rank"]].to_numpy(), kind[2]["share"].to_numpy(np.int64), kind[2]["n"].to_numpy(np.int64)
        for side, other, flip in ((left, right, False), (right, left, True)):
            own = np.flatnonzero(side)
            for k, g in enumerate(own):
                mine = owner == g
                if mine.any():
                    more = ((_apart(share[mine][:, None], zero[other][None, :]) - _apart(zero[g], zero[other])[None, :]) * n[mine][:, None]).sum(axis=0)
                    if flip:
                        total[:, k] += more
                    else:
                        total[k] += more
    g, h = np.meshgrid(rank[left], rank[right], indexing="ij")
    once = g < h
    return pd.DataFrame({"lang": lang, "g": g[once], "h": h[once], "value": total[once]})


def _light_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, g, h, value) from posting lists of light terms: for each two sources that say a term, what the background and the
    histograms have not counted. Sums by pair within a slice."""
    for b in slices(batches, 8192):
        langs, lists = b.column(0).to_pandas(), b.column(1)
        flat, cuts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not len(langs):
            continue
        rank, share, zero = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        starts = np.concatenate([[0], np.cumsum(cuts)])[:-1]
        code, names = pd.factorize(langs)
        out = []
        for size in np.unique(cuts):
            rows = np.flatnonzero(cuts == size)
            at = starts[rows][:, None] + np.arange(size)
            for i in range(size):
                for j in range(i + 1, size):
                    x, y = at[:, i], at[:, j]
                    value = _apart(share[x], share[y]) - _apart(share[x], zero[y]) - _apart(zero[x], share[y]) + _apart(zero[x], zero[y])
                    out.append(pd.DataFrame({"lang": code[rows], "g": np.minimum(rank[x], rank[y]), "h": np.maximum(rank[x], rank[y]), "value": value}))
        if out:
            summed = pd.concat(out).groupby(["lang", "g", "h"], as_index=False)["value"].sum()
            summed["lang"] = names[summed["lang"]]
            yield pa.RecordBatch.from_pandas(summed, pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("value", pa.int64())]), preserve_index=False)


class Shares:
    """The kept terms of each language and their shares by group, as tables."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS):
        counts = cut(term_counts(docs, lang_col, source_col, text_col), "counts")
        kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("in_lang"), F.count("*").alias("n_sources")).filter(F.col("docs") >= min_docs)
        self.kept = cut(kept.select("lang", "term", "in_lang", "n_sources"), "kept")
        self.postings = cut(counts.join(self.kept, ["lang", "term"]).select("lang", "source", "term", "count", "in_lang", "n_sources"), "postings")
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("in_lang").alias("lang_total"))
        totals = self.postings.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kinds", "lang_total"])
        # One row a source, of which the result has one for every two.
        rank = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
        self.groups = cut(groups.withColumns({"zero": _share("0", "total", "kinds"), "rank": rank}), "groups")
        cols = ["lang", "source", "total", "kinds", "lang_total", "zero", "rank"]
        self.shares = cut(self.postings.join(self.groups.select(*cols), ["lang", "source"]).withColumns({"p": _share("count", "total", "kinds"), "q": _share("in_lang", "lang_total", "kinds")}), "shares")


def top_terms(shares: Shares, top: int = TOP) -> DataFrame:
    """A source's most typical terms: those it says more often than its language does, by value."""
    value = F.expr("(p - q) * (p - q) div (p + q)")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return shares.shares.filter("p > q").select("lang", "source", "term", value.alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def pair_sums(shares: Shares, light: int = LIGHT, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, g, h, value) for every two sources of a language, by rank, g < h."""
    heavy, rare = shares.shares.filter(F.col("n_sources") > light), shares.shares.filter(F.col("n_sources") <= light)
    blocks = shares.kept.groupBy("lang").agg(F.count(F.when(F.col("n_sources") <= light, 1)).alias("n_light"), (1 + F.expr(f"count_if(n_sources > {light}) div {block}")).alias("blocks"))
    spans = shares.groups.groupBy("lang").agg(F.expr(f"max(rank) div {tile}").alias("last"))
    spans = cut(spans.join(blocks, "lang", "left").na.fill({"n_light": 0, "blocks": 1}), "spans")  # one row a language

    def tiled(rows: DataFrame) -> DataFrame:
        """Rows for each two tiles of which one is theirs."""
        own = F.expr(f"rank div {tile}")
        tiles = F.expr("sequence(0L, last)")
        return rows.join(spans.select("lang", "last"), "lang").withColumn("t", F.explode(tiles)).withColumns({"a": F.least("t", own), "b": F.greatest("t", own)}).drop("t", "last")

    none = F.lit(None).cast("string")
    at = shares.groups.join(spans.select("lang", "n_light", "blocks"), "lang").select("lang", "rank", F.col("zero").alias("share"), "n_light", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    at = at.select("lang", "block", F.lit(0).alias("kind"), "rank", "share", none.alias("term"), F.when(F.col("block") == 0, F.col("n_light")).otherwise(0).cast("long").alias("n"))
    dense = heavy.join(spans.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), "rank", F.col("p").alias("share"), "term", F.lit(1).cast("long").alias("n"))
    owed = rare.groupBy("lang", "rank", "p").agg(F.count("*").alias("n")).select("lang", F.lit(0).cast("long").alias("block"), F.lit(2).alias("kind"), "rank", F.col("p").alias("share"), none.alias("term"), "n")
    rows = tiled(at.unionByName(dense).unionByName(owed))
    schema = "lang string, g long, h long, value long"
    tiles = rows.groupBy("lang", "a", "b", "block").applyInPandas(lambda part: _tile_sums(part, tile), schema)
    lists = rare.filter("n_sources > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("rank", F.col("p").alias("share"), "zero")).alias("said"))
    return tiles.unionByName(lists.select("lang", "said").mapInArrow(_light_pairs, schema)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, light: int = LIGHT, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, every other source of the language by how far it is; part `term`, the terms
    that tell a source from its language."""
    shares = Shares(docs, lang_col, source_col, text_col, min_docs)
    sums = cut(pair_sums(shares, light, block, tile), "sums")
    names = shares.groups.select("lang", "rank", "source")
    both = sums.unionAll(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    both = both.join(names.withColumnRenamed("rank", "g"), ["lang", "g"]).join(names.select("lang", F.col("rank").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = both.select("lang", "source", "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(top_terms(shares).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
