"""Single-linkage hierarchy of a weighted graph: Boruvka's minimum spanning forest, and clusters cut from it.

In every round each component takes its lightest edge to another one, all at once, and components that took
edges become one; so rounds number the logarithm of the components.  No step collects nodes or edges.  Before the first
round each task drops the edges that close a cycle among its own: such an edge is in no minimum
spanning forest, and what is left is less than a task's nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept

#: Edges that a task takes up before it drops those that close cycles.
TAKEN = 1 << 20


def _lightest(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the edges (u, v) of a minimum spanning forest; edges stand in their order."""
    label, left, taken = np.arange(nodes), np.arange(len(u)), [np.empty(0, np.int64)]
    while True:
        x, y = label[u[left]], label[v[left]]
        between = x != y
        left, x, y = left[between], x[between], y[between]
        if not len(left):
            return np.sort(np.concatenate(taken))
        first = np.full(nodes, len(u))
        first[x[::-1]] = left[::-1]  # the last one written is the first edge
        second = np.full(nodes, len(u))
        second[y[::-1]] = left[::-1]
        first = np.minimum(first, second)
        own = np.flatnonzero(first < len(u))
        taken.append(np.unique(first[own]))
        parent = np.arange(nodes)
        ends = label[u[first[own]]], label[v[first[own]]]
        parent[own] = np.where(ends[0] == own, ends[1], ends[0])
        mutual = own[(parent[parent[own]] == own) & (own < parent[own])]
        parent[mutual] = mutual
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _thinned(edges: DataFrame) -> DataFrame:
    """(a, b, height) without the edges that are last in a cycle of one task's edges, in the order of (height, a, b)."""

    def forest(table: pa.Table) -> pa.Table:
        a, b = (table[c].to_numpy() for c in "ab")
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        order = np.lexsort((v, u, table["height"].to_numpy()))
        return table.take(pa.array(order[_lightest(u[order], v[order], len(names))]))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                fresh += batch.num_rows
            if fresh >= TAKEN:
                held, fresh = forest(pa.Table.from_batches(held)).to_batches(), 0
        if held:
            yield from forest(pa.Table.from_batches(held)).to_batches()

    return edges.mapInArrow(thin, edges.schema)


def _jumped(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest of (node, parent) in which roots are their own parents: paths are halved until none is left."""
    now = kept(parents.select("node", "parent"), "parents")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        new = kept(now.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        now = new.select("node", "parent")
        if new.filter("moved").isEmpty():
            return now.withColumnRenamed("parent", "root")


def _edges(links: DataFrame, a: str, b: str, height: str) -> DataFrame:
    """(a, b, height), each pair once, a before b."""
    x, y = F.col(a), F.col(b)
    edges = links.filter(x.isNotNull() & y.isNotNull() & F.col(height).isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(height).alias("height"))
    return kept(_thinned(edges).groupBy("a", "b").agg(F.min("height").alias("height")), "edges")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (a, b, height) of ``_edges``, and each node's component (node, root)."""
    labels = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "labels")
    forest = edges.limit(0)
    between = edges.select("a", "b", "height", F.col("a").alias("u"), F.col("b").alias("v"))
    while not between.isEmpty():
        both = between.union(between.select("a", "b", "height", F.col("v"), F.col("u")))
        lightest = kept(both.groupBy("u").agg(F.min(F.struct("height", "a", "b", "v")).alias("e")).select("u", "e.*"), "lightest")
        forest = kept(forest.union(lightest.select("a", "b", "height").distinct()), "forest")
        # two components that took the same edge would point at each other: the smaller one is the root
        other = lightest.select(F.col("u").alias("v"), F.col("v").alias("back"))
        taken = lightest.join(other, "v", "left")
        mutual = F.coalesce((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.lit(False))
        roots = _jumped(taken.select(F.col("u").alias("node"), F.when(mutual, F.col("u")).otherwise(F.col("v")).alias("parent")))
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
        labels = kept(labels.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")  # components without an edge left stay
        ends = step.select(F.col("root").alias("u"), F.col("new").alias("nu")), step.select(F.col("root").alias("v"), F.col("new").alias("nv"))
        between = kept(between.join(ends[0], "u").join(ends[1], "v").filter("nu <> nv").select("a", "b", "height", F.col("nu").alias("u"), F.col("nv").alias("v")), "between")
    return forest, labels


def spanning_forest(links: DataFrame, a: str, b: str, height: str) -> DataFrame:
    """(a, b, height): a minimum spanning forest of an undirected graph, a before b.

    Edges are ordered by height, then by their ends, so the forest is one and the same in every run.  Loops, null
    ends and null heights are no edges; of parallel edges the lowest counts.
    """
    return _contracted(_edges(links, a, b, height))[0]


def merges(forest: DataFrame) -> DataFrame:
    """(a, b, height, place): the joins of single linkage from the lowest on; each is between the clusters that hold a and b by then."""
    place = F.row_number().over(Window.orderBy("height", "a", "b"))  # a report: one row a join
    return forest.withColumn("place", place)


def cut(nodes: DataFrame, node: str, forest: DataFrame, height: float) -> DataFrame:
    """(node, cluster): single-linkage clusters of all nodes at a height, named by their least node; nodes without a link are their own."""
    roots = _contracted(_edges(forest.filter(F.col("height") <= height), "a", "b", "height"))[1]
    named = roots.groupBy("root").agg(F.min("node").alias("cluster"))
    low = roots.join(named, "root").select("node", "cluster")
    return nodes.select(F.col(node).alias("node")).distinct().join(low, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
