"""Incremental ingest and windowed event rollups with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import upsert


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    """New parquet files below ``path``, a bounded number per batch, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_rollup(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; state older than the watermark is dropped, so it stays bounded."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def stream_upserts(source: DataFrame, target: str, keys: list[str], order_col: str, checkpoint: str):
    """A query that merges each batch into the versioned table at ``target``: the latest row per key stays.

    Version n is a folder of its own, written from version n - 1 and the batch; a batch delivered twice rewrites its own
    folder, so replays change nothing.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch
        if n > 0:
            new = upsert(spark.read.schema(batch.schema).parquet(f"{target}/v{n - 1}"), batch, keys, order_col)
        else:
            new = upsert(batch, batch.limit(0), keys, order_col)
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/v{n}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
