"""The inverted-file index against all cosines, and blocked exact top-k on ties and hard rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from strataforge.operators import similarity, vector_index
from strataforge.operators.tables import shared_path


def nearest(rows, k):
    rows = [(i, np.array(v, np.float64)) for i, v in rows]
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for i, (key, _) in enumerate(rows):
        if key % 20 == 0:
            score = np.round(x @ x[i], 9)
            out[key] = [rows[j][0] for j in sorted((j for j in range(len(rows)) if rows[j][0] != key), key=lambda j: (-score[j], rows[j][0]))[:k]]
    return out


def recall(found, want):
    return sum(len(set(found.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    from strataforge.plans import queries

    rows = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = {}
    for query, rank, vec, _ in queries.QUERIES["rag01_vector_index"](spark, f"/root/testdata/{scale}").collect():
        found.setdefault(query, {})[rank] = vec
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in found.values())
    assert recall({q: list(v.values()) for q, v in found.items()}, nearest(rows, 20)) >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.2).tolist()) for i in range(1200)]
    hard = [(5000, None), (5020, [0.0] * 16), (5040, [math.nan] * 16), (None, rows[0][1]), (5060, [None] * 16)]
    return rows, spark.createDataFrame(rows + hard, "vec_id long, embedding array<double>")


def test_clustered_vectors_need_few_cells_and_appended_rows_are_found(spark, clustered):
    rows, df = clustered
    path = shared_path(spark, "index-test")
    model = vector_index.build(df.filter("vec_id is null or vec_id < 1000 or vec_id >= 5000"), "vec_id", "embedding", path)
    assert model.probes < len(model.centroids) / 3
    vector_index.append(df.filter("vec_id >= 1000 and vec_id < 5000"), "vec_id", "embedding", path)
    got = vector_index.search(df.filter("vec_id % 20 = 0"), "vec_id", "embedding", path, 10)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {}
    for r in got.collect():
        found.setdefault(r["query"], []).append(r["key"])
    assert recall(found, nearest(rows, 10)) >= 0.95 and any(k >= 1000 for v in found.values() for k in v)


def test_split_cells_and_all_probes_are_exact(spark, clustered, monkeypatch):
    rows, df = clustered
    for name, value in (("ROWS", 40), ("QUERIES", 3), ("AGAIN", 20)):
        monkeypatch.setattr(vector_index, name, value)
    path = shared_path(spark, "index-test")
    vector_index.build(df, "vec_id", "embedding", path, cells=5)
    found = {}
    for r in vector_index.search(df.filter("vec_id % 20 = 0"), "vec_id", "embedding", path, 10, probes=5).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["key"])
    assert found == nearest(rows, 10)


def test_nothing_to_index(spark):
    assert vector_index.build(spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", shared_path(spark, "index-test")) is None


def test_top_k_in_blocks(spark, clustered, monkeypatch):
    rows, df = clustered
    monkeypatch.setattr(similarity, "TOP_BLOCK", 100)
    tied = rows + [(20_001 + i, rows[0][1]) for i in range(8)]
    df = spark.createDataFrame(tied, "vec_id long, embedding array<double>")
    out = similarity.top_k(df, "vec_id", "embedding", df.filter("vec_id % 20 = 0"), 5)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    found = {}
    for r in out.orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["vec_id"])
    assert found == nearest(tied, 5)


def test_a_task_makes_a_bounded_number_of_probes_at_a_time():
    rng = np.random.default_rng(6)
    x, centroids = rng.normal(size=(3000, 8)), rng.normal(size=(60, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "vector"])
    made = list(vector_index._probes(batch, centroids, 50))
    assert max(b.num_rows for b in made) <= vector_index.PROBED and sum(b.num_rows for b in made) == 3000 * 50
    got = {(q, c) for b in made for q, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist())}
    assert got == {(q, int(c)) for q in range(3000) for c in np.argsort(-(x[q] @ centroids.T))[:50]}
    assert all(np.array_equal(v, x[q]) for q, v in zip(made[-1].column(0).to_pylist(), made[-1].column(1).to_pylist()))
