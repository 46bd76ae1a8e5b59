"""Structured Streaming: the latest diagnostics of each document, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.diagnostics import latest


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, tie: str, **trigger) -> StreamingQuery:
    """Keeps the last row of each key below path, a version folder for each micro-batch.

    Every batch writes the whole state, so this is for small states of which each version is wanted; runs.merge_stream writes
    what a batch brings.
    A batch is merged with the last complete version; a batch that runs again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        latest(rows, key, version, tie).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def window_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and summed values of event types in tumbling or sliding windows; rows later than `late` are left out of streams."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap without events."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
