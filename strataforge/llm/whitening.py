"""Embedding whitening from an exact scatter matrix kept in residues.

Entries are made integers.  Every task multiplies blocks of them modulo several primes:
residues are centred and blocks short enough that no sum of a double-precision matrix
product reaches 2**53, so the products are exact.  Spark adds the residues up, the driver
puts the integers together again by Chinese remaindering (columns squared, never rows), and one
double-precision ``eigh`` of the exact covariance gives the components.  The order in
which rows are read or tasks end changes no bit of the fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import share, written

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Primes below 2**22: centred residues are below 2**21, so 2**11 rows of products stay below 2**53.
PRIME_BITS, BLOCK = 22, 1 << 11
#: Rows of a batch that are worked on at a time.
ROWS = 1 << 13


def finite(vector: str = "embedding") -> Column:
    """The vector is there and holds neither null, NaN nor infinity."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as doubles, shorter ones ending in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def whole(c: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift; what has no place in 62 bits is set to the nearest that has."""
    return np.clip(np.floor(scale * c), -(2.0**62), 2.0**62).astype(np.int64) + shift


def primes(beyond: int) -> list[int]:
    """The largest primes of ``PRIME_BITS`` bits whose product exceeds ``beyond``."""
    found, product, p = [], 1, (1 << PRIME_BITS) + 1
    while product <= beyond:
        p -= 2
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
    return found


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo ``p`` of an integer matrix, each entry in 0 to p - 1."""
    r = x % p
    r = np.where(r > p // 2, r - p, r).astype(np.float64)
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for i in range(0, len(r), BLOCK):
        part = r[i : i + BLOCK]
        total = (total + (part.T @ part).astype(np.int64)) % p
    return total


def remainders_joined(residues: list[int], moduli: list[int]) -> int:
    """The integer nearest to 0 that leaves ``residues`` modulo ``moduli``."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def scatter(rows: DataFrame, dim: int, greatest: int, n: int, vector: str = "embedding") -> list[list[int]]:
    """Exact x' x of all ``rows``, where x is their integers and a last column of ones.

    ``greatest`` bounds the integers' absolute value.  The last row holds the sums and, at its end, n.
    """
    moduli = primes(2 * n * max(greatest, 1) ** 2)
    side = dim + 1
    upper = np.triu_indices(side)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((side, side), np.int64) for _ in moduli]
        seen = False
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                c = padded(batch.column(0).slice(i, ROWS), dim)
                x = np.concatenate([whole(c, SCALE, SHIFT), np.ones((len(c), 1), np.int64)], 1)
                sums = [(s + residue_scatter(x, p)) % p for s, p in zip(sums, moduli, strict=True)]
                seen = True
        for k, s in enumerate(sums if seen else []):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper[0]), k, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(s[upper])], names=["prime", "cell", "residue"])

    reduced = rows.select(vector).mapInArrow(partial, "prime int, cell int, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue"))
    found = np.zeros((len(moduli), len(upper[0])), np.int64)
    for k, cell, residue in reduced.collect():  # (dim + 1) squared cells a prime, whatever the number of rows
        found[k, cell] = residue % moduli[k]
    matrix = [[0] * side for _ in range(side)]
    for cell, (i, j) in enumerate(zip(*upper, strict=True)):
        matrix[i][j] = matrix[j][i] = remainders_joined([int(v) for v in found[:, cell]], moduli)
    return matrix


class Fit:
    """Number of vectors, their exact sums, and the components of their covariance."""

    def __init__(self, matrix: list[list[int]], components: int):
        self.n, self.sums = matrix[-1][-1], matrix[-1][:-1]
        n, s, d = self.n, self.sums, len(self.sums)
        # n * n times the covariance is an integer; its quotient is rounded once
        covariance = np.array([[(n * matrix[i][j] - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)], np.float64).reshape(d, d)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        trace = sum(n * matrix[i][i] - s[i] * s[i] for i in range(d)) / (n * n)
        self.values, self.components = values[order], vectors[:, order]
        self.explained = self.values / trace if trace else np.zeros(len(order))
        #: Directions without variance cannot be whitened; eigh leaves rounding there.
        self.solid = self.values > (values[-1] if d else 0) * d * np.finfo(np.float64).eps


def deviations(x: np.ndarray, n: int, sums: list[int], greatest: int) -> tuple[np.ndarray, list[Decimal | None]]:
    """n * x - S in doubles, and the sums of its squares, exact; null beyond 38 digits."""
    most = n * greatest + max(map(abs, sums), default=0)
    if len(sums) * most * most < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return y.astype(np.float64), [Decimal(v) for v in (y * y).sum(1).tolist()]
    y = n * x.astype(object) - np.array(sums, object)
    square = (y * y).sum(1) if y.shape[1] else [0] * len(y)
    return y.astype(np.float64), [Decimal(v) if v < 10**38 else None for v in square]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Fitted on all rows of ``vectors`` whose ``embedding`` is there and finite.  x is the
    vector's integers, n the number of fitted rows and S their sums by dimension; deviation is
    the sum of (n * x - S)**2, exact (decimal; null beyond 38 digits), whitened x - S / n
    on the component over the root of its eigenvalue, explained the eigenvalue's share of the
    trace, and identity_error how far the covariance of all whitened values is from the identity.

    Rows without a usable vector are left out.  Each repeated row and each row that repeats an id counts and
    is returned; a null vec_id is kept.  Vectors shorter than the longest end in zeros.
    Integers beyond 62 bits are set to the limit.  A component without variance
    has whitened null and does not enter identity_error, which is null where there is no other.  Components
    number no more than dimensions; equal eigenvalues come in ``eigh``'s order.  Other columns are
    ignored, and no rows give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter(finite())
    schema = T.StructType([rows.schema["vec_id"], *(T.StructField(*f) for f in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    largest = F.coalesce(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))), F.lit(0.0))
    n, dim, most = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(largest)).first()
    if not n or not dim:
        return spark.createDataFrame([], schema)
    greatest = min(math.floor(SCALE * most) + 1, 1 << 62) + SHIFT
    fit = Fit(scatter(rows, dim, greatest, n), components)
    shared = share(spark, fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared()
        root = np.sqrt(np.where(fit.solid, fit.values, 1))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                y, deviation = deviations(whole(padded(part.column(1), dim), SCALE, SHIFT), fit.n, fit.sums, greatest)
                out = (y / fit.n) @ fit.components / root
                flat = pa.array(out.ravel(), mask=~np.broadcast_to(fit.solid, out.shape).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    done = written(rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    k = len(fit.values)
    solid = [i for i in range(k) if fit.solid[i]]
    error = None
    if solid:
        means = done.agg(*(F.avg(F.col("whitened")[i]) for i in solid)).first()
        centred = [F.col("whitened")[i] - F.lit(float(m)) for i, m in zip(solid, means, strict=True)]
        pairs = [(i, j) for i in range(len(solid)) for j in range(i + 1)]
        found = done.agg(*(F.sum(centred[i] * centred[j]) / n for i, j in pairs)).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
    shares = F.array(*(F.lit(float(v)) for v in fit.explained))
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
