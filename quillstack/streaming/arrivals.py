"""Arrivals as a stream: idempotent ingest of a landing folder, and windowed counts of events.

An addition: a library of files has no stream of its own; its rule that a content is taken in once holds here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack.operators.gram_index import GramIndex
from quillstack.operators.library import dedup_files
from quillstack.sources.shared import epochs


def landing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(path)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, id_col: str = "id", text_col: str = "text") -> StreamingQuery:
    """Append contents not seen before to target, one folder a batch, so that a batch that runs again replaces itself."""

    def take(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [f for f in epochs(spark, target) if f < epoch]
        known = spark.read.parquet(*[f"{target}/epoch={f}" for f in done]).select("sha256") if done else None
        fresh = dedup_files(batch, known, text_col, id_col).filter("status = 'ok'").drop("status", "first")
        fresh.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_index(stream: DataFrame, index: GramIndex, checkpoint: str, after: int = -1) -> StreamingQuery:
    """Changes (id, text, version) put into an index, one epoch a batch, numbered on from `after`; a null text takes its row
    out, and of several changes of one id in a batch the last version holds. A batch that runs again writes its epoch again."""

    def take(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("id").orderBy(F.desc("version"))
        now = batch.withColumn("n", F.row_number().over(last)).filter("n = 1").persist()
        index.apply(now.filter("text is not null").select("id", "text"), after + 1 + number, now.filter("text is null").select("id"))
        now.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; later than the watermark allows, events are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    w = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
