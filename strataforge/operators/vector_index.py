"""An inverted-file index of vectors for retrieval by cosine.

``build`` finds coarse centroids by k-means over the partitions, gives every vector to the cell of
its nearest centroid, codes what is left by product quantisation, and writes cells as
Parquet partitions.  ``append`` adds rows without a rebuild.  ``search`` reads only the cells that a query
probes, ranks their rows by codes, and ranks the best again by their exact vectors.

The number of cells probed is measured when the index is built: the true neighbours of a bounded
sample of queries are found, and the fewest probes that cover ``SURE`` of them are kept in the model.  The
model (centroids, code books, probes) is bounded by ``MOST_CELLS`` and is all that the driver holds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .similarity import top_k, unit
from .tables import kept

MOST_CELLS = 4096
#: Passes of k-means, rows a centroid that a pass reads (mini-batches by hash), rows that fit the code books.
PASSES, BATCH, CODED = 6, 256, 16_384
#: Dimensions of a part of a code and code words of a part.
PART, WORDS = 4, 256
#: Share of the sample's true neighbours that the probed cells must hold, and the sample's queries.
SURE, ASKED, NEIGHBOURS = 0.97, 128, 20
#: Candidates by code, as a multiple of k, that are ranked again exactly; rows and queries of a cell that meet in one task.
AGAIN, ROWS, QUERIES = 10, 1 << 15, 1 << 12
#: Rows (query, cell) that a task makes at a time: each holds the query's vector.
PROBED = 1 << 14


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.empty((0, 0))


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of length 1; without null, non-finite and zero vectors."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return unit(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter("key is not null").filter(F.coalesce(fine, F.lit(False))), "vector")


class Model:
    """Centroids, code books of the parts, and cells to probe."""

    def __init__(self, centroids: np.ndarray, books: list[np.ndarray], probes: int):
        self.centroids, self.books, self.probes = centroids, books, probes

    def save(self, spark: SparkSession, path: str) -> None:
        said = json.dumps({"centroids": self.centroids.tolist(), "books": [b.tolist() for b in self.books], "probes": self.probes})
        spark.createDataFrame([(said,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        said = json.loads(spark.read.parquet(f"{path}/model").first()[0])
        return Model(np.array(said["centroids"]), [np.array(b) for b in said["books"]], said["probes"])

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, 1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([np.argmin((b**2).sum(1) - 2 * rest[:, PART * i : PART * i + PART] @ b.T, 1) for i, b in enumerate(self.books)], 1).astype(np.uint8)

    def nearness(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(query, row) inner products with what the codes stand for."""
        out = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), 1)
        for i, b in enumerate(self.books):
            out += (queries[:, PART * i : PART * i + PART] @ b.T)[:, codes[:, i]]
        return out


def _centroids(rows: DataFrame, n: int, cells: int) -> np.ndarray:
    """Spherical k-means: each pass adds up a hashed batch's vectors by nearest centroid in the tasks."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("key", F.lit(0)), "key").limit(cells).select("vector").collect()
    centroids = np.array([r[0] for r in first], np.float64)
    share = max(1, n // (BATCH * cells))
    for turn in range(PASSES):
        sent = spark.sparkContext.broadcast(centroids)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    own = np.argmax(x @ c.T, 1)
                    np.add.at(sums, own, x)
                    counts += np.bincount(own, minlength=len(c))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["cell", "total"])

        batch = rows.filter(F.pmod(F.xxhash64("key", F.lit(turn + 1)), F.lit(share)) == 0).select("vector")
        sums = batch.mapInArrow(partial, "cell int, total array<double>").select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("v"))
        new = np.zeros_like(centroids)
        for cell, place, v in sums.collect():  # cells x dimensions
            new[cell, place] = v
        length = np.linalg.norm(new, axis=1, keepdims=True)
        centroids = np.where(length > 0, new / np.maximum(length, 1e-300), centroids)
    return centroids


def _books(rest: np.ndarray) -> list[np.ndarray]:
    """Code words of each part by k-means of a bounded sample."""
    out = []
    for i in range(0, rest.shape[1], PART):
        x = rest[:, i : i + PART]
        book = np.unique(x, axis=0)
        book = book[np.linspace(0, len(book) - 1, min(WORDS, len(book))).astype(int)]
        for _ in range(PASSES):
            own = np.argmin((book**2).sum(1) - 2 * x @ book.T, 1)
            count = np.bincount(own, minlength=len(book))
            sums = np.stack([np.bincount(own, x[:, j], len(book)) for j in range(x.shape[1])], 1)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
        out.append(book)
    return out


def _placed(rows: DataFrame, model: Model) -> DataFrame:
    """(key, cell, codes, vector) of usable rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x):
                cell = sent.value.cell(x)
                codes = [c.tobytes() for c in sent.value.codes(x, cell)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(1), pa.array(cell.astype(np.int32))], names=["key", "codes", "vector", "cell"])

    return rows.select("key", "vector").mapInArrow(place, f"key {kind}, codes binary, vector array<double>, cell int")


def _write(rows: DataFrame, path: str) -> None:
    # rebalancing splits a cell that is too large for one file
    rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def build(rows: DataFrame, key: str, vector: str, path: str, cells: int | None = None) -> Model | None:
    """Write an index of ``rows`` below ``path``; None and nothing written if no row has a usable vector.

    Null keys, and null, zero and non-finite vectors are left out; rows that repeat a key are each a row.  All vectors
    must have one length.
    """
    spark = rows.sparkSession
    rows = kept(usable(rows, key, vector), "vectors")
    n = rows.count()
    if not n:
        return None
    cells = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, n))
    model = Model(_centroids(rows, n, cells), [], cells)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("key", F.lit(-1)), "key").limit(CODED).select("vector").collect()], np.float64)
    model.books = _books(sample - model.centroids[model.cell(sample)])
    placed = _placed(rows, model)
    _write(placed, path)
    asked = rows.orderBy(F.xxhash64("key", F.lit(-2)), "key").limit(ASKED)
    near = top_k(rows, "key", "vector", asked, NEIGHBOURS)
    order = {r[0]: np.argsort(np.argsort(-(model.centroids @ np.array(r[1])))) for r in asked.collect()}
    stored = spark.read.parquet(f"{path}/cells").select("key", "cell")
    ranks = sorted(int(order[q][cell]) + 1 for q, cell in near.join(stored, "key").select("query", "cell").collect())  # ASKED x NEIGHBOURS rows
    model.probes = ranks[min(len(ranks) - 1, math.ceil(SURE * len(ranks)))] if ranks else cells
    model.save(spark, path)
    return model


def append(rows: DataFrame, key: str, vector: str, path: str) -> None:
    """Add rows to the index with the model it has."""
    _write(_placed(usable(rows, key, vector), Model.load(rows.sparkSession, path)), path)


def _probes(batch: pa.RecordBatch, centroids: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """(query, q, cell) of each cell that a query (key, vector) probes, at most PROBED rows at a time or one query's."""
    x, step = matrix(batch.column(1)), max(1, PROBED // probes)
    for i in range(0, len(x), step):
        near = np.argpartition(-(x[i : i + step] @ centroids.T), probes - 1, 1)[:, :probes]
        at = pa.array(np.repeat(np.arange(i, i + len(near)), probes))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["query", "q", "cell"])


def search(queries: DataFrame, key: str, vector: str, path: str, k: int, probes: int | None = None) -> DataFrame:
    """(query, rank, key, score): up to ``k`` nearest rows found for each query but rows with its own key, by exact cosine; ties to the smaller key."""
    spark = queries.sparkSession
    model = Model.load(spark, path)
    probes = min(probes or model.probes, len(model.centroids))
    sent = spark.sparkContext.broadcast(model)
    kind = queries.schema[key].dataType.simpleString()
    stored = spark.read.parquet(f"{path}/cells")
    asked = usable(queries, key, vector)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _probes(batch, sent.value.centroids, probes)

    probed = asked.mapInArrow(probe, f"query {kind}, q array<double>, cell int")
    # a cell's rows and queries are cut into parts that fit a task, and every two parts meet
    rows_in = stored.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("row_parts"))
    asks_in = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_parts"))
    parts = rows_in.join(asks_in, "cell")  # at most MOST_CELLS rows
    left = probed.join(F.broadcast(parts), "cell").withColumn("b", F.pmod(F.xxhash64("query"), F.col("query_parts")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))
    right = stored.select("cell", "key", "codes").join(F.broadcast(parts), "cell").withColumn("a", F.pmod(F.xxhash64("key"), F.col("row_parts")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    keep = AGAIN * k

    def rank(q: pa.Table, rows: pa.Table) -> pa.Table:
        names = {"query": q["query"][:0], "key": rows["key"][:0], "guess": pa.array([], pa.float64()), "cell": pa.array([], pa.int32())}
        if not len(q) or not len(rows):
            return pa.table(names)
        cell = int(q["cell"][0].as_py())
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
        x, out = matrix(q["q"]), []
        for i in range(0, len(x), 256):
            score = sent.value.nearness(x[i : i + 256], cell, codes)
            best = np.argpartition(-score, min(keep, len(rows)) - 1, 1)[:, : min(keep, len(rows))]
            at = np.repeat(np.arange(i, i + len(score)), best.shape[1])
            out.append((at, best.ravel(), np.take_along_axis(score, best, 1).ravel()))
        at, row, score = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"query": q["query"].take(pa.array(at)), "key": rows["key"].take(pa.array(row)), "guess": score, "cell": np.full(len(at), cell, np.int32)})

    row_kind = stored.schema["key"].dataType.simpleString()
    found = left.select("cell", "a", "b", "query", "q").groupBy("cell", "a", "b").cogroup(right.select("cell", "a", "b", "key", "codes").groupBy("cell", "a", "b")).applyInArrow(rank, f"query {kind}, key {row_kind}, guess double, cell int")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "key"))
    again = found.filter("key <> query").withColumn("n", first).filter(F.col("n") <= keep).select("query", "key", "cell")
    exact = again.join(stored.select("key", "cell", "vector"), ["cell", "key"]).join(asked.select(F.col("key").alias("query"), F.col("vector").alias("q")), "query")
    score = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    exact = exact.select("query", "key", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key"))
    return exact.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "rank", "key", "score")
