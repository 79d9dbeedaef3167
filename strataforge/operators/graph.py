"""Property graph as two DataFrames, nodes(id, label, ...) and edges(src, type, dst): closure, degree, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends known, and their labels; dangling edges go."""
    s = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    d = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src").join(d, "dst").select("src", "type", "dst", "src_label", "dst_label")


def closure(edges: DataFrame, kind: str, depth: int) -> DataFrame:
    """(src, dst, depth): paths of 1 to ``depth`` edges of a type, each pair at its least depth."""
    step = edges.filter(F.col("type") == kind).select("src", "dst").distinct()
    level = step.withColumn("depth", F.lit(1))
    every = level
    for d in range(2, depth + 1):
        level = level.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct().withColumn("depth", F.lit(d))
        every = every.union(level)
    return every.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, degree) of every node that has an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def connected(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` nodes with most edges."""
    return degree(edges).join(nodes.select("id", "label", "name"), "id").orderBy(F.desc("degree"), "id").limit(k)


def frequent(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent (type, source label, target label)."""
    return endpoints(edges, nodes).groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "src_label", "dst_label").limit(k)


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def density(n_nodes: Column, n_edges: Column) -> Column:
    """Edges over ordered pairs of nodes, 0 for fewer than two nodes."""
    return F.coalesce(F.try_divide(n_edges, n_nodes * (n_nodes - 1)), F.lit(0.0))


def co_neighbours(edges: DataFrame, kind: str, least: int) -> DataFrame:
    """(a, b, shared): sources that share at least ``least`` targets of a type; a target with many sources is counted, not collected."""
    e = edges.filter(F.col("type") == kind).select("src", "dst").distinct()
    x, y = e.select(F.col("src").alias("a"), "dst"), e.select(F.col("src").alias("b"), "dst")
    return x.join(y, "dst").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def absent(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert-if-absent: ``df`` and the rows of ``new`` whose key it lacks, one a key."""
    return df.unionByName(new.dropDuplicates(key).join(df.select(*key), key, "left_anti"))


def common_types(rows: DataFrame, group: str, kind: str, least: float) -> DataFrame:
    """Kinds that more than ``least`` of all groups have, with the share."""
    total = rows.agg(F.count_distinct(group).alias("total"))
    per = rows.groupBy(kind).agg(F.count_distinct(group).alias("n"), F.count("*").alias("rows"))
    share = F.try_divide(F.col("n"), F.col("total"))
    return per.join(F.broadcast(total)).withColumn("share", share).filter(F.col("share") > least).select(kind, "n", "rows", F.round("share", 6).alias("share"))
