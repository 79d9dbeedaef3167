"""Exact top-k by integer inner product with vector-approximation files.

Two files are written: cells (a few bits a dimension) and exact vectors.  Every block of
queries scans the cells alone: two matrix products with the cells' lower and upper ends bound each score
from both sides, and a row whose upper bound is below ``top`` + 1 lower bounds is out.
The exact vectors of what is left are then read in the order of their bounds, in rounds of
growing length, until the last result of each query is certain: no unread row has a bound as good.

Equal integer vectors score alike, so only the ``top`` + 1 of them with the smallest ids can be
among anyone's results, and equal queries are asked once.  Both are exact, and keep a vector with a
third of all copies from meeting itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .whitening import finite, padded, whole
from .workspace import discard, scratch, share, written

TOP = 20
SCALE = 64
#: Bits of a dimension's cell.
BITS = 6
#: Bytes of distinct query vectors that go out together: all that is broadcast.
ASK_BYTES = 1 << 22
#: Vectors whose exact scores give a block's first thresholds, and rows of cells and queries bounded at a time.
SAMPLE, ROWS, SLICE = 1 << 11, 1 << 12, 1 << 10
#: Candidates of a query whose exact vectors the first round reads, and how much further each next round goes.
FIRST, FURTHER = 2, 4
#: Rows of equal vectors are thinned in so many parts before they meet.
SALTS = 64


class Cells:
    """The integers at which each dimension is cut into cells, from the dimension's least and greatest."""

    def __init__(self, least: np.ndarray, greatest: np.ndarray):
        steps = np.arange((1 << BITS) + 1)
        span = [int(b) - int(a) + 1 for a, b in zip(least, greatest, strict=True)]
        #: (dimension, cell) first integers; one more closes the last cell.
        self.first = np.array([[int(a) + s * int(k) // (1 << BITS) for k in steps] for a, s in zip(least, span, strict=True)], np.int64).reshape(len(span), len(steps))
        low, high = self.first[:, :-1].astype(np.float64), np.maximum(self.first[:, 1:] - 1, self.first[:, :-1]).astype(np.float64)
        self.middle, self.half = (low + high) / 2, (high - low) / 2
        self.most = float(max([1, *np.abs(self.first).max(1)])) if len(span) else 1.0

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of every entry of (row, dimension) integers."""
        out = np.empty(x.shape, np.uint8)
        for j in range(x.shape[1]):  # of empty cells with one first integer, the last holds it
            out[:, j] = np.minimum(np.searchsorted(self.first[j], x[:, j], "right") - 1, (1 << BITS) - 1)
        return out

    def slack(self, queries: np.ndarray) -> float:
        """What a double-precision sum may be off; 0 while all sums are exact."""
        size = queries.shape[1] * float(np.abs(queries).max(initial=0)) * self.most
        return 0.0 if size < 2.0**53 else size * (queries.shape[1] + 2) * 2.0**-52

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) lower and upper bounds of the inner products."""
        at = np.arange(cells.shape[1])
        middle = queries @ self.middle[at, cells].T
        around = np.abs(queries) @ self.half[at, cells].T + self.slack(queries)
        return middle - around, middle + around


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binaries."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x.tobytes())])


def _unpack(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    size = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if size < 1 << 63:
        return np.einsum("ij,ij->i", a, b)
    return np.array([int(v) for v in (a.astype(object) * b.astype(object)).sum(1)], object)


def _last_of(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, 1)[:, values.shape[1] - k]


def possible(lower: np.ndarray, upper: np.ndarray, known: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) places that may be among the first k, and each query's k-th lower bound; rows come in the order of their ids.

    k rows anywhere reach the score ``known``, k rows with smaller ids than these reach ``before``.
    """
    own = _last_of(lower, k)
    least = np.maximum(known, own)
    q, r = np.nonzero((upper >= least[:, None]) & (upper > before[:, None]))
    for j in np.flatnonzero(np.bincount(q, minlength=len(lower)) > 4 * k):  # many ties
        above = int((lower[j] > least[j]).sum())
        ties = np.flatnonzero(lower[j] == least[j])
        if above < k <= above + len(ties):  # what can no more than tie with k rows of smaller ids is out
            keep = (q != j) | (upper[j][r] > least[j]) | (r <= ties[k - above - 1])
            q, r = q[keep], r[keep]
    return q, r, own


def _thinned(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k rows with the smallest ids: first by parts, so that no task gets all copies of one."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    for keys in (["exact", "salt"], ["exact"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("vec_id").asc_nulls_last(), "row"))
        salted = salted.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    return salted.drop("salt")


class _Search:
    """What the blocks of queries share: the two files and how cells are cut."""

    def __init__(self, table: DataFrame, dim: int, k: int):
        self.spark, self.dim, self.k = table.sparkSession, dim, k
        self.kind = table.schema["vec_id"].dataType.simpleString()
        spans = table.select("exact").mapInArrow(self._ends, "place int, least long, greatest long").groupBy("place").agg(F.min("least"), F.max("greatest")).orderBy("place").collect()
        self.cells = Cells(np.array([r[1] for r in spans], np.int64), np.array([r[2] for r in spans], np.int64))
        self.sent = share(self.spark, self.cells)
        sent = self.sent

        def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, _pack(sent().of(_unpack(batch.column(2), dim, np.int64)))], names=["vec_id", "row", "exact", "cells"])

        kept = _thinned(table.select("vec_id", "row", "exact"), k).select("vec_id", "row", "exact")
        self.files = written(kept.mapInArrow(quantise, f"vec_id {self.kind}, row long, exact binary, cells binary"), "va-files")
        rows = self.files.select("exact").limit(SAMPLE).collect()
        self.sample = np.array([np.frombuffer(r[0], np.int64) for r in rows], np.float64).reshape(-1, dim)

    @property
    def _ends(self):
        dim = self.dim

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _unpack(batch.column(0), dim, np.int64)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(x.min(0)), pa.array(x.max(0))], names=["place", "least", "greatest"])

        return ends

    def candidates(self, ids: np.ndarray, x: np.ndarray) -> DataFrame:
        """(query, row, vec_id, bound, place): rows that cells cannot rule out, place by place in the order of their upper bounds."""
        dim, k, sent = self.dim, self.k, self.sent
        wide = x.astype(np.float64)
        known = np.concatenate([_last_of(wide[i : i + SLICE] @ self.sample.T, k) for i in range(0, len(wide), SLICE)]) - self.cells.slack(wide)
        shared = share(self.spark, (ids, wide, known))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x, known = shared()
            before = np.full(len(ids), -np.inf)
            found: list[tuple] = []

            def survivors() -> list[tuple]:
                q, row, upper = (np.concatenate([f[i] for f in found]) for i in range(3))
                vec = pa.concat_arrays([f[3] for f in found])
                keep = upper >= np.maximum(known, before)[q]
                return [(q[keep], row[keep], upper[keep], vec.filter(pa.array(keep)))]

            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    cell, row, vec = _unpack(part.column(2), dim, np.uint8), part.column(1).to_numpy(), part.column(0)
                    for a in range(0, len(x), SLICE):
                        s = slice(a, a + SLICE)
                        lower, upper = sent().bounds(x[s], cell)
                        q, r, own = possible(lower, upper, known[s], before[s], k)
                        before[s] = np.maximum(before[s], own)
                        found.append((q + a, row[r], upper[q, r], vec.take(pa.array(r))))
                    if sum(len(f[0]) for f in found) > 1 << 20:
                        found = survivors()
            for q, row, upper, vec in survivors() if found else []:
                for i in range(0, len(q), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[s]]), pa.array(row[s]), vec[s], pa.array(upper[s])], names=["query", "row", "vec_id", "bound"])

        # in the order of ids, so that ties with earlier rows of the task can be dropped on the way
        ordered = self.files.select("vec_id", "row", "cells").sortWithinPartitions(F.col("vec_id").asc_nulls_last(), "row")
        found = ordered.mapInArrow(scan, f"query long, row long, vec_id {self.kind}, bound double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), F.col("vec_id").asc_nulls_last(), "row"))
        return written(found.withColumn("place", place), "va-candidates")

    def answers(self, ids: np.ndarray, x: np.ndarray) -> DataFrame:
        """(query, row, vec_id, score): at least the k best rows of each query of the block, with their exact scores."""
        k, dim = self.k, self.dim
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        ranked = self.candidates(ids, x)
        shared = share(self.spark, (ids, x))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = shared()
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    at = np.searchsorted(ids, part.column(0).to_numpy())
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(dots(x[at], _unpack(part.column(3), dim, np.int64)), pa.int64())], names=["query", "row", "vec_id", "score"])

        done, tables, begin, end, open_ = None, [ranked], 0, FIRST * k, None
        while True:
            unread = ranked.filter((F.col("place") > begin) & (F.col("place") <= end)).select("query", "row", "vec_id")
            unread = unread if open_ is None else unread.join(open_, "query", "left_semi")
            read = unread.join(self.files.select("row", "exact"), "row").select("query", "row", "vec_id", "exact")
            read = written(read.mapInArrow(scored, f"query long, row long, vec_id {self.kind}, score long"), "va-read")
            tables.append(read)
            done = read if done is None else done.union(read)
            best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
            last = done.withColumn("n", best).filter(F.col("n") == k).select("query", F.col("vec_id").alias("last_id"), "score")
            # the next unread row has the best bound of all that are unread; with an equal one, the smallest id
            ahead = ranked.filter(F.col("place") == end + 1).join(last, "query")
            sooner = F.col("vec_id").isNotNull() & (F.col("last_id").isNull() | (F.col("vec_id") <= F.col("last_id")))
            more = written(ahead.filter((F.col("bound") > F.col("score")) | ((F.col("bound") == F.col("score")) & (sooner | F.col("last_id").isNull()))).select("query"), "va-open")
            tables.append(more)
            if more.isEmpty():
                done.__dict__["tables"] = tables
                return done
            begin, end, open_ = end, end * FURTHER, more


def search(vectors: DataFrame, queries: Column | None = None, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best rows of each query by integer inner product, exactly.

    An entry x counts as floor(64 * x).  Queries are the rows that ``queries`` names (by
    default those whose vec_id is divisible by 20), candidates all rows but the query's own; ties go to the smaller
    vec_id, a null one last.  Each row that repeats an id is a query and a candidate of its own.
    Rows whose vector is null or holds null or non-finite entries take no part; shorter vectors end in
    zeros, and a zero vector scores 0.  Integers beyond 62 bits are set to the limit; a
    score beyond 64 bits is an error.  Other columns are ignored; no rows give none.
    """
    spark = vectors.sparkSession
    k = top + 1  # the query's own row may be among them
    chosen = F.coalesce(F.col("vec_id") % 20 == 0 if queries is None else queries, F.lit(False))
    usable = vectors.select("vec_id", "embedding", chosen.alias("asks")).filter(finite())
    n, dim = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score long"
    if not n:
        return spark.createDataFrame([], schema)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _pack(whole(padded(batch.column(1), dim), SCALE, 0))], names=["vec_id", "asks", "exact"])

    table = written(usable.mapInArrow(exact, f"vec_id {kind}, asks boolean, exact binary").withColumn("row", F.monotonically_increasing_id()), "va-rows")
    asked = written(table.filter("asks").groupBy("exact").agg(F.min("row").alias("query")), "va-queries")
    count = asked.count()
    if not count:
        return spark.createDataFrame([], schema)
    shared = _Search(table, dim, k)
    most = max(1, ASK_BYTES // (8 * max(1, dim)))
    blocks = 1 if count <= most else math.ceil(2 * count / most)
    path = scratch(spark, "va-found")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "exact").collect()  # half of ASK_BYTES, give or take chance
        if rows:
            found = shared.answers(np.array([r[0] for r in rows], np.int64), np.array([np.frombuffer(r[1], np.int64) for r in rows], np.int64).reshape(-1, dim))
            found.withColumn("n", best).filter(F.col("n") <= k).drop("n").write.mode("append").parquet(path)
            discard(*found.__dict__["tables"])
    own = table.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "exact").join(asked, "exact").select("query_id", "own", "query")
    results = own.join(spark.read.schema(f"query long, row long, vec_id {kind}, score long").parquet(path), "query").filter("row <> own")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))
    return results.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Brute force: every query against every row.
ORACLE_SQL = """
with v as (
    select row_number() over () as own, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.own, q.vec_id as query_id, c.vec_id, c.own as other, list_dot_product(q.e, c.e)::bigint as score
    from v q join v c on q.own <> c.own
    where q.vec_id % 20 = 0
), r as (
    select query_id, vec_id, score, row_number() over (partition by own order by score desc, vec_id nulls last, other) as rank from s
)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""
