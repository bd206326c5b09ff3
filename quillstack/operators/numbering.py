"""Places of rows in a total order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.sources.shared import cut


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in ascending order of the columns given (nulls first).

    Rows go to ranges of the order, which are written; a place is the number of rows in the ranges before plus the place
    within the range. Rows should be narrow. Rows equal in these columns get places next to each other, in the order of a hash of the
    whole row, so that a value that very many rows share is no single range.
    """
    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    ranges = cut(tied.repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    ahead = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "_tie"))
    return ranges.join(F.broadcast(ahead), "_range").withColumn(name, (F.col("_ahead") + within).cast("long")).drop("_range", "_ahead", "_tie")
