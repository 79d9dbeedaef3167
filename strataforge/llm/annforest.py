"""Nearest neighbours by a hash-prefix forest.

Every tree gives each vector a 62-bit string, the signs of its projections on
random orthogonal directions, and keeps the strings sorted.  A query descends in
all trees to the vectors that share a prefix with it, and ascends in all trees at
once, to ever shorter prefixes, until a vector as near as its ``TOP``-th neighbour would
have been met in some tree with probability ``SURE``.  How near that is, a bounded
sample says; near neighbours need few candidates, far ones many, and there is no
cap on them.

Vectors are made unit length for hashing by one more coordinate (the largest norm
bounds them), so angles order them as inner products do.  Trees are cut into cells by
their first bits, and cells of more than ``PART`` vectors into parts, each held by one
task with the queries that reach it.  Of equal vectors only the ``TOP`` + 1 with the
smallest ids can be among anyone's nearest; the others stay out of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import partitions, share, written

TOP = 20
TREES, BITS = 32, 62
#: Wanted chance of meeting a vector as near as the last neighbour.
SURE = 0.93
#: Vectors of the sample that tells how near a query's neighbours are.
SAMPLE = 4096
#: Vectors of a cell that one task holds, give or take chance, and most first bits that name a cell.
PART, CELL_BITS = 1 << 16, 12
SEED = 6


def usable(vector: str = "embedding") -> Column:
    """No null, NaN or infinite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Forest:
    """The directions of all trees, and what turns a vector into its bit strings."""

    def __init__(self, dim: int, norm: float):
        rng = np.random.default_rng(SEED)
        self.norm = norm
        turns = -(-BITS // (dim + 1))
        self.directions = np.concatenate([np.concatenate([np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0] for _ in range(turns)], 1)[:, :BITS] for _ in range(TREES)], 1)
        self.weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(vector, tree) bit strings."""
        length = np.linalg.norm(x, axis=1)
        x = x / (length if query else self.norm)[:, None] if query else x / self.norm
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (length / self.norm) ** 2))
        signs = np.concatenate([x, last[:, None]], 1) @ self.directions > 0
        return signs.reshape(len(x), TREES, BITS) @ self.weights

    def level(self, nearness: np.ndarray) -> np.ndarray:
        """Prefix length at which a vector of that cosine is met in some tree with probability ``SURE``."""
        same = 1 - np.arccos(np.clip(nearness, -1, 1 - 1e-9)) / np.pi
        one = 1 - (1 - SURE) ** (1 / TREES)
        return np.clip(np.floor(np.log(one) / np.log(np.maximum(same, 1e-9))), 0, BITS).astype(np.int64)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, role, string, id, level, vector) in order, queries (role 0) before candidates: nearest of each query."""

    def nearest(queries: list[tuple], candidates: list[tuple]) -> pa.RecordBatch:
        out = [], [], []
        if queries and candidates:
            strings, ids, vectors = (np.concatenate([c[k] for c in candidates]) for k in (0, 1, 3))
            q_string, q_id, q_level, q_vector = (np.concatenate([q[k] for q in queries]) for k in range(4))
            for i in range(0, len(q_id), 512):
                scores = q_vector[i : i + 512] @ vectors.T
                drop = np.minimum(BITS - q_level[i : i + 512], BITS)
                first = np.searchsorted(strings, (q_string[i : i + 512] >> drop) << drop)
                past = np.searchsorted(strings, ((q_string[i : i + 512] >> drop) + 1) << drop)
                for j in range(len(scores)):
                    a, b = first[j], past[j]
                    row, own = scores[j, a:b], ids[a:b]
                    row = np.where(own == q_id[i + j], -np.inf, row)
                    least = -np.partition(-row, TOP - 1)[TOP - 1] if len(row) > TOP else -np.inf
                    best = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (own != q_id[i + j])) if np.isfinite(least) else np.flatnonzero(own != q_id[i + j])
                    # summed in one order wherever a pair meets, so that it scores the same in every tree
                    row = (vectors[a:b][best] * q_vector[i + j]).sum(1)
                    order = np.lexsort((own[best], -row))[:TOP]
                    best, row = best[order], row[order]
                    out[0].append(np.full(len(best), q_id[i + j])), out[1].append(own[best]), out[2].append(row)
        kinds = (np.int64, np.int64, np.float64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *o]).astype(k)) for o, k in zip(out, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    place, queries, candidates = None, [], []
    for batch in batches:
        cell, part, role, string, ids, level = (batch.column(k).to_numpy() for k in range(6))
        vectors = _matrix(batch.column(6))
        here = np.stack([cell, part], 1)
        cuts = np.concatenate([[0], np.flatnonzero((here[1:] != here[:-1]).any(1) | (role[1:] != role[:-1])) + 1, [len(cell)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if place != (cell[a], part[a]):
                if place is not None:
                    yield nearest(queries, candidates)
                place, queries, candidates = (cell[a], part[a]), [], []
            if role[a] == 0:
                queries.append((string[a:b], ids[a:b], level[a:b].astype(np.int64), vectors[a:b]))
            elif queries:
                candidates.append((string[a:b], ids[a:b], level[a:b], vectors[a:b]))
    if place is not None:
        yield nearest(queries, candidates)


def search(vectors: DataFrame, queries: Column | None = None, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query, nearest first, ties to the smaller vec_id.

    Queries are the rows of ``vectors`` that ``queries`` names (by default those whose vec_id
    is divisible by 20), candidates all rows but the query's own; score is the
    inner product of the original vectors in double precision.  Rows with a null id,
    or a null, zero or non-finite vector, or one of another length than most, take
    no part.  Of rows that repeat an id the one with the least vector counts.  Other
    columns are ignored; no rows give none.
    """
    assert top <= TOP, "the index keeps no more equal vectors"
    spark = vectors.sparkSession
    chosen = F.col("vec_id") % 20 == 0 if queries is None else queries
    rows = vectors.select("vec_id", "embedding", chosen.alias("asks")).filter("vec_id is not null").filter(usable())
    rows = written(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")), "ann-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return empty
    dim, n = int(sizes[0]["dim"]), int(sizes[0]["count"])
    rows = rows.filter(F.size("embedding") == dim)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = math.sqrt(rows.agg(F.max(square)).first()[0])
    few = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.withColumn("copy", few).filter(F.col("copy") <= TOP + 1).select("vec_id", "embedding")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").collect()
    known_ids = np.array([r[0] for r in sample])
    known = np.array([r[1] for r in sample], np.float64)
    shared = share(spark, (Forest(dim, norm), known_ids, known))
    place = math.ceil(1.5 * top * len(known) / n) + 1  # a little beyond the last neighbour's, as the sample varies

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, known_ids, known = shared()
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if not len(ids):
                continue
            near = x @ known.T / (np.linalg.norm(x, axis=1)[:, None] * forest.norm)
            near[ids[:, None] == known_ids[None, :]] = -1
            near = -np.partition(-near, min(place, near.shape[1]) - 1, 1)[:, min(place, near.shape[1]) - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.level(near).astype(np.int32)), batch.column(1)], names=["vec_id", "level", "embedding"])

    asked = written(rows.filter("asks").select("vec_id", "embedding").mapInArrow(ask, "vec_id long, level int, embedding array<float>"), "ann-queries")
    lowest = asked.agg(F.min("level")).first()[0]
    if lowest is None:
        return empty
    bits = int(min(CELL_BITS, max(lowest, math.ceil(math.log2(max(1, n / PART))))))
    schema = "cell int, part int, role int, string long, vec_id long, level int, embedding array<float>"

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared()[0]
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                codes = forest.strings(_matrix(part.column(1)), False)
                cell = (np.arange(TREES) << bits) + (codes >> (BITS - bits))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().astype(np.int32)), pa.array(codes.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), TREES))], names=["cell", "string", "vec_id"])

    counted = kept.mapInArrow(strings, "cell int, string long, vec_id long").groupBy("cell").count().collect()  # at most TREES << CELL_BITS rows
    parts = np.zeros(TREES << bits, np.int64)
    for cell, size in counted:
        parts[cell] = -(-size // PART)
    layout = share(spark, parts)

    def place_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = shared()[0], layout()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                ids = rows.column(0).to_numpy()
                codes = forest.strings(_matrix(rows.column(1)), False)
                cell = ((np.arange(TREES) << bits) + (codes >> (BITS - bits))).ravel()
                own = np.repeat(ids, TREES)
                mixed = (own * np.int64(-7046029254386353131)) >> 33
                size = len(cell)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array((mixed % np.maximum(parts[cell], 1)).astype(np.int32)), pa.array(np.ones(size, np.int32)), pa.array(codes.ravel()), pa.array(own), pa.array(np.zeros(size, np.int32)), rows.column(1).take(pa.array(np.repeat(np.arange(len(ids)), TREES)))],
                    names=["cell", "part", "role", "string", "vec_id", "level", "embedding"],
                )

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = shared()[0], layout()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                ids, level = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
                codes = forest.strings(_matrix(rows.column(2)), True)
                spread = 1 << np.maximum(0, bits - level)  # cells of a tree below a prefix shorter than a cell's
                q = np.repeat(np.arange(len(ids)), TREES * spread)
                k = np.concatenate([np.arange(TREES * s) for s in spread]) if len(ids) else np.empty(0, np.int64)
                tree, low = k // spread[q], k % spread[q]
                first = ((codes[q, tree] >> (BITS - bits)) // spread[q]) * spread[q] + low
                cell = (tree << bits) + first
                n = parts[cell]
                q, tree, cell = np.repeat(q, n), np.repeat(tree, n), np.repeat(cell, n)
                part = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(q), np.int32)), pa.array(codes[q, tree]), pa.array(ids[q]), pa.array(level[q].astype(np.int32)), rows.column(2).take(pa.array(q))],
                    names=["cell", "part", "role", "string", "vec_id", "level", "embedding"],
                )

    def find(asked: DataFrame) -> DataFrame:
        placed = kept.mapInArrow(place_candidates, schema).union(asked.mapInArrow(place_queries, schema))
        dealt = placed.repartition(partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "role", "string")
        return written(dealt.mapInArrow(_search, "query_id long, vec_id long, score double").distinct(), "ann-found")

    need = min(top, sum(r["count"] for r in counted) // TREES - 1)
    found = find(asked)
    while True:  # queries that found too few ascend further, in the end to the root
        enough = found.groupBy("query_id").count().filter(F.col("count") >= need).select(F.col("query_id").alias("vec_id"))
        short = written(asked.join(enough, "vec_id", "left_anti").filter("level > 0").select("vec_id", F.floor(F.col("level") / 2).cast("int").alias("level"), "embedding"), "ann-queries")
        if short.isEmpty():
            break
        again = short.select(F.col("vec_id").alias("query_id"))
        found, asked = found.join(again, "query_id", "left_anti").union(find(short)), short
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_exactly(vectors: DataFrame, top: int = TOP) -> dict[int, list[int]]:
    """Brute force on the driver, for tests and for measuring recall on small tables."""
    rows = vectors.filter("vec_id is not null").filter(usable()).select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.where(np.arange(len(ids)) == i, -np.inf, x @ x[i])
        out[int(ids[i])] = [int(v) for v in ids[np.lexsort((ids, -score))[: min(top, len(ids) - 1)]]]
    return out
