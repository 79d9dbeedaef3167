"""Exact top-k search and whitening against plain loops, and on hard rows."""

import math
import random

import numpy as np
import pytest

from strataforge.llm import vafile, whitening

SCHEMA = "vec_id long, embedding array<float>, query_id long, score string, exact binary"


def plain_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)], i, "x", b"y") for i in range(230)]
    rows += [(i, rows[3][1], 0, None, None) for i in range(230, 330)]  # one vector in a hundred copies
    rows += [(i, [0.0] * 12, 0, None, None) for i in range(330, 345)]
    rows += [(i, [0.001 * (i % 3)] * 12, 0, None, None) for i in range(345, 350)]  # zero once cut
    rows += [rows[40], rows[40], (60, rows[7][1], 0, None, None)]  # repeated rows and ids
    rows += [(400, None, 0, None, None), (420, [None] + [0.1] * 11, 0, None, None), (440, [math.nan] + [0.1] * 11, 0, None, None), (460, [math.inf] * 12, 0, None, None)]
    rows += [(480, [0.3, -0.2], 0, None, None), (500, [], 0, None, None), (None, rows[9][1], 0, None, None)]
    return rows


def as_stored(rows):
    return [(r[0], [float(np.float32(c)) for c in r[1]]) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(plain_vectors(), SCHEMA).repartition(5)


def test_top_k_is_brute_force(vectors):
    rows = as_stored(plain_vectors())
    cut = [[math.floor(64 * c) for c in v] + [0] * (12 - len(v)) for _, v in rows]
    want = []
    for i, (query, _) in enumerate(rows):
        if query is not None and query % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(cut[i], cut[j])), rows[j][0] is None, rows[j][0] or 0, j) for j in range(len(rows)) if j != i)[:20]
            want += [(query, n, None if none else vec, -s) for n, (s, none, vec, _) in enumerate(best, 1)]
    got = [tuple(r) for r in vafile.search(vectors).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_top_k_in_small_blocks_and_rounds(vectors, monkeypatch):
    whole = sorted(map(repr, vafile.search(vectors).collect()))
    monkeypatch.setattr(vafile, "ASK_BYTES", 800)
    monkeypatch.setattr(vafile, "BITS", 2)
    monkeypatch.setattr(vafile, "FIRST", 1)
    monkeypatch.setattr(vafile, "FURTHER", 2)
    assert sorted(map(repr, vafile.search(vectors).collect())) == whole


def test_top_k_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.integers(-70, 50, (200, 9))
    cells = vafile.Cells(x.min(0), x.max(0))
    lower, upper = cells.bounds(x[:20].astype(float), cells.of(x))
    exact = x[:20] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all() and (lower < upper).any()


def test_top_k_few_or_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vafile.search(none).count() == 0 and whitening.whiten(none).count() == 0
    one = spark.createDataFrame([(20, [0.5], 0, None, None)], SCHEMA)
    assert vafile.search(one).count() == 0
    few = spark.createDataFrame([(20, [0.5], 0, None, None), (21, [1.0], 0, None, None), (23, [2.0], 0, None, None)], SCHEMA)
    assert [tuple(r) for r in vafile.search(few).orderBy("rank").collect()] == [(20, 1, 23, 32 * 128), (20, 2, 21, 32 * 64)]


def test_top_k_beyond_doubles(spark):
    rows = [(20 * i, [float(2**20 + i), 3.0e5, -(2.0**19)], 0, None, None) for i in range(30)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in vafile.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, a long, b string, c binary"), top=5).collect()}
    cut = [[math.floor(64 * c) for c in r[1]] for r in rows]
    for i, r in enumerate(rows):
        best = sorted((-sum(a * b for a, b in zip(cut[i], cut[j])), rows[j][0]) for j in range(30) if j != i)[:5]
        assert [got[r[0], n] for n in range(1, 6)] == [(v, -s) for s, v in best]


def test_whitening_is_exact(vectors):
    rows = as_stored(plain_vectors())
    x = [[math.floor(1024 * c) + 100000 for c in v] + [100000] * (12 - len(v)) for _, v in rows]
    n, sums = len(x), [sum(r[j] for r in x) for j in range(12)]
    deviation = {}
    for (vec, _), r in zip(rows, x):
        deviation.setdefault(vec, set()).add(sum((n * a - s) ** 2 for a, s in zip(r, sums)))
    centred = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], np.float64) / n
    covariance = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1]
    got = whitening.whiten(vectors).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(v, d) for v, ds in deviation.items() for d in ds}
    for k in range(8):
        own = [r for r in got if r["component"] == k + 1]
        assert abs(own[0]["explained"] - values[k] / np.trace(covariance)) < 1e-9
        # the projections of all rows have the moments of that eigenvalue
        assert abs(np.mean([r["whitened"] ** 2 for r in own]) - 1) < 1e-9 and abs(np.mean([r["whitened"] for r in own])) < 1e-9
    w = {}
    for r in got:
        w.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], r["whitened"])
    v = np.linalg.eigh(covariance)[1][:, ::-1][:, :8] / np.sqrt(values[:8])
    for (vec, _), r, c in zip(rows, x, centred):
        mine = w[vec, sum((n * a - s) ** 2 for a, s in zip(r, sums))]
        assert np.allclose(np.abs([mine[k + 1] for k in range(8)]), np.abs(c @ v), atol=1e-6)


def test_remainders_and_residues():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**9), 10**9, (5000, 4))
    exact = x.astype(object).T @ x.astype(object)
    moduli = whitening.primes(2 * max(abs(v) for v in exact.ravel()))
    parts = [whitening.residue_scatter(x, p) for p in moduli]
    assert all(whitening.remainders_joined([int(p[i, j]) for p in parts], moduli) == exact[i, j] for i in range(4) for j in range(4))
    assert all(p < 1 << 22 and all(p % q for q in range(2, 2100)) for p in moduli)


def test_whitening_without_variance(spark):
    rows = [(i, [0.5, float(i % 2)], 0, None, None) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True)}
    assert got[0]["identity_error"] < 1e-12
    same = whitening.whiten(spark.createDataFrame([(1, [2.0], 0, None, None)] * 3, SCHEMA)).collect()
    assert [(r["whitened"], r["deviation"], r["identity_error"]) for r in same] == [(None, 0, None)] * 3


def test_deviation_beyond_long(spark):
    rows = [(i, [1e15 * (i + 1), -2.0], 0, None, None) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, a long, b string, c binary")).collect()
    x = [[math.floor(1024 * c) + 100000 for c in r[1]] for r in rows]
    sums = [sum(r[j] for r in x) for j in range(2)]
    want = {r[0]: sum((4 * a - s) ** 2 for a, s in zip(v, sums)) for r, v in zip(rows, x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == want
