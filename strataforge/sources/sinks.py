"""Sinks: JSON documents, criteria tables, graph tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, path: str, key: str = "artifact_name") -> None:
    """One JSON row per artifact, in a folder per artifact."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def table(df: DataFrame, path: str) -> None:
    """A CSV with a header; arrays, maps and structs become JSON text."""
    plain = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)


def envelope(df: DataFrame, path: str, **about: str) -> None:
    """Rows as JSON with a metadata struct beside the data."""
    info = F.struct(*[F.lit(v).alias(k) for k, v in about.items()], F.current_timestamp().alias("written"))
    df.select(info.alias("metadata"), F.struct("*").alias("data")).write.mode("overwrite").json(path)


def merged_scores(components: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per artifact: a column for each dimension's score, total and decision."""
    from ..plans.agents import WEIGHTS

    wide = components.groupBy("artifact_name").pivot("dimension", sorted(WEIGHTS)).agg(F.first("score"))
    return wide.join(decisions.select("artifact_name", "total", "accepted"), "artifact_name")


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by type, so that queries on one read only it."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def report(rows: DataFrame, line: str, path: str) -> None:
    """A text report: one line a row, from a SQL expression."""
    rows.select(F.expr(line).alias("value")).write.mode("overwrite").text(path)


def profiles(rows: DataFrame, path: str) -> None:
    """Venue profiles as JSON, with the time they were made."""
    rows.withColumn("generated", F.current_timestamp()).write.mode("overwrite").json(path)
