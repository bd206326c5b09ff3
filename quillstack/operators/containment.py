"""Which texts stand in which others, joined on the rarest piece of the shorter one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.sources.shared import cut, discard

#: Length of a piece at first; texts that hold a piece, above which a longer one is looked for.
PIECE, FREQUENT = 12, 1000


def pieces(t: str, width: int) -> Column:
    """The different pieces of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - width + 1), lambda i: F.substring(t, i, F.lit(width))))


def contained(shorts: DataFrame, longs: DataFrame, least: int = PIECE, frequent: int = FREQUENT) -> DataFrame:
    """(s, l): different texts of shorts(t), of `least` characters and more, and the different texts of longs(t) that hold them.

    Each short text goes by the one of its pieces that fewest long texts hold; one whose pieces are all frequent tries pieces of twice
    the length, until it is itself about a piece and what holds that holds it. So titles of one beginning do not all meet, and what
    meets is little more than the result. A text with a piece that no long text holds is done at once.
    """
    left = cut(shorts.filter(F.length("t") >= least).select(F.col("t").alias("s")).distinct(), "shorts")
    longs = cut(longs.filter(F.length("t") >= least).select(F.col("t").alias("l")).distinct(), "longs")
    found, width = None, least
    while True:
        own = left.select("s", F.explode(pieces("s", width)).alias("piece"))
        there = longs.filter(F.length("l") >= width).select("l", F.explode(pieces("l", width)).alias("piece"))
        # Of few short texts the pieces are few: long texts' pieces are then dropped where they are made.
        held = there.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
        # min skips what no long text holds, so it is told apart by its count.
        rarest = own.join(held, "piece", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("m")).select("s", "m.n", "m.piece").filter("n > 0")
        rarest = cut(rarest, "rarest")
        again = (F.col("n") > frequent) & (F.length("s") >= 2 * width)
        met = rarest.filter(~again).join(there, "piece").filter(F.contains("l", "s")).select("s", "l")
        found = met if found is None else found.unionByName(met)
        last, left = left, cut(rarest.filter(again).select("s"), "shorts")
        discard(last)
        if left.isEmpty():
            return found
        width *= 2
