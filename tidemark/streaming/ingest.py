"""Structured Streaming ingest of interactions, and windowed counts for trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """First arrival of each interaction key; keys are forgotten once they are older
    than the watermark, so state stays bounded."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events by target, type and event-time window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = stream.withWatermark("ts", delay).groupBy(w, "target", "type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "target", "type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user").agg(F.count("*").alias("n"))
    return rows.select("user", F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet by type, all that is there now, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("type").trigger(availableNow=True).outputMode("append").start()
