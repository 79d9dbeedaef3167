"""Incremental ingest and windowed aggregates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total): tumbling one-hour windows; the same plan on a table and on a stream."""
    w = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def arrivals(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Files as they arrive; those already read are skipped by the stream's checkpoint."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``apply(batch, number)`` on what has newly arrived, then stop."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_safe(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Events with a watermark; later ones are dropped by windowed aggregates."""
    return events.withWatermark("ts", lateness)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, n): session windows of each user."""
    w = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
