"""Connected components of a link table, wholly as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Each round maps every node to the neighbour (or itself) that comes first in an
    order by hash and contracts the links so, which leaves loops and repeats away.
    A star is gone after two or three rounds, and any chain shrinks by a constant
    factor a round, so links are joined a few times, not once for every step of a
    long path.  Links to itself and repeated links change nothing; null ends are
    dropped; an empty table gives an empty one.
    """
    rank = lambda x: F.struct(F.xxhash64(x), F.col(x))
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().filter("x <> y")
    edges = written(one.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        first = both.groupBy("x").agg(F.min(rank("y")).alias("near"))
        first = first.select(F.col("x").alias("node"), F.when(rank("x") < F.col("near"), F.col("x")).otherwise(F.col("near.y")).alias("to"))
        step = written(first, "cc-map")
        maps.append(step)
        left, right = (step.select(F.col("node").alias(n), F.col("to").alias(f"{n}_to")) for n in "xy")
        moved = edges.join(left, "x").join(right, "y").filter("x_to <> y_to")
        shrunk = written(moved.select(F.least("x_to", "y_to").alias("x"), F.greatest("x_to", "y_to").alias("y")).distinct(), "cc-edges")
        discard(edges)
        edges = shrunk
    if not maps:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    label = maps[0].select("node", "to")
    for step in maps[1:]:  # nodes that a later round no longer knows stay as they are
        further = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        label = label.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    label = written(label, "cc-labels")
    discard(edges, *maps)
    low = label.groupBy("to").agg(F.min("node").alias("component"))
    return label.join(low, "to").select("node", "component")
