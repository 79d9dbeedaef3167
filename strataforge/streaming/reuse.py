"""Reuse of what was done before: keyed state by content, kept over triggers and restarts, with a time-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How long a content counts as done.
DAYS = 30
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh(stream: DataFrame, content: Column | str, days: int = DAYS) -> DataFrame:
    """(artifact, digest, path, seen): the contents of an artifact that no trigger of the last ``days`` brought.

    ``stream`` has artifact, path and the content; nulls count as empty. Of equal contents in one trigger one
    row stays, with the path of any of them. A content that changes and changes back within that time is
    reused too. State holds a row for each artifact and digest, spread by both, on disk beside
    the executors and in the checkpoint; the time is that of arrival, so no row is ever late.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a trigger writes what changed, not the whole state
    column = F.col(content) if isinstance(content, str) else content
    digest = F.sha2(F.coalesce(column.cast("binary"), F.lit("").cast("binary")), 256)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = stream.select(text("artifact"), digest.alias("digest"), text("path"), F.current_timestamp().alias("seen"))
    return rows.withWatermark("seen", f"{days} days").dropDuplicatesWithinWatermark(["artifact", "digest"])


def work(stream: DataFrame, content: Column | str, out: str, checkpoint: str, days: int = DAYS) -> None:
    """Write what is fresh among all that has newly arrived to the Parquet table ``out``, a folder a trigger, then stop.

    A trigger that is repeated after a failure writes its folder anew, so nothing is done twice or lost.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    fresh(stream, content, days).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
