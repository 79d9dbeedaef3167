"""Boruvka's forest against Kruskal's, and single-linkage heights against a plain agglomeration."""

import numpy as np

from strataforge.operators import hierarchy


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for h, a, b in sorted((h, min(a, b), max(a, b)) for a, b, h in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, h))
    return sorted(out)


def test_heights_are_those_of_plain_single_linkage(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 6))
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 6)
    edges = [(i, j, float(d[i, j])) for i in range(200) for j in range(i)]
    got = hierarchy.spanning_forest(spark.createDataFrame(edges, "x long, y long, h double"), "x", "y", "h").cache()
    assert sorted(tuple(r) for r in got.collect()) == kruskal(edges)
    members, heights = {i: {i} for i in range(200)}, []
    linked = d + np.diag(np.full(200, np.inf))
    while len(members) > 1:  # join the two nearest clusters, again and again
        i, j = np.unravel_index(np.argmin(linked), linked.shape)
        heights.append(float(linked[i, j]))
        linked[i] = linked[:, i] = np.minimum(linked[i], linked[j])
        linked[i, i] = np.inf
        linked[j] = linked[:, j] = np.inf
        members[i] |= members.pop(j)
        if len(members) == 20:
            flat = {n: min(m) for m in members.values() for n in m}
            at = heights[-1]
    assert [r["height"] for r in hierarchy.merges(got).orderBy("place").collect()] == heights
    nodes = spark.range(203).toDF("n")
    assert dict(map(tuple, hierarchy.cut(nodes, "n", got, at).collect())) == flat | {200: 200, 201: 201, 202: 202}


def test_ties_loops_parallels_and_parts(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(h)) for a, b, h in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.integers(0, 3, 150))]
    edges += [(100, 101, 1.0), (101, 100, 0.0), (5, 5, 0.0)]
    hard = [(None, 3, 0.0), (3, None, 0.0), (200, 201, None)]
    got = hierarchy.spanning_forest(spark.createDataFrame(edges + hard, "a long, b long, height double"), "a", "b", "height")
    assert sorted(tuple(r) for r in got.collect()) == kruskal([e for e in edges if e[0] != e[1]])
    none = spark.createDataFrame([], "a long, b long, height double")
    assert hierarchy.spanning_forest(none, "a", "b", "height").count() == 0


def test_the_query(spark):
    from strataforge.plans import queries

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    edges = [(rows[i]["vec_id"], rows[j]["vec_id"], round(1 - s[i, j], 9)) for i in range(len(rows)) for j in range(i) if s[i, j] > 0.35 and rows[i]["label"] != rows[j]["label"]]
    got = sorted(r["height"] for r in queries.QUERIES["pip02_semantic_hierarchy"](spark, sf).collect())
    assert np.allclose(got, sorted(round(h, 5) for _, _, h in kruskal(edges)), atol=2e-5)


def test_a_task_sends_on_no_more_edges_than_a_forest(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(h)) for a, b, h in zip(rng.integers(0, 50, 3000), rng.integers(50, 90, 3000), rng.integers(0, 4, 3000))]
    edges = spark.createDataFrame(rows, "a long, b long, height double").coalesce(1)
    thin = [tuple(r) for r in hierarchy._thinned(edges).collect()]
    assert len(thin) <= 89 and kruskal(thin) == kruskal(rows)
    assert sorted(map(tuple, hierarchy.spanning_forest(edges, "a", "b", "height").collect())) == kruskal(rows)


def test_taking_up_edges_in_parts_leaves_the_same_forest(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "TAKEN", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rng = np.random.default_rng(5)
        rows = [(f"k{a:02}", f"k{b:02}", float(h)) for a, b, h in zip(rng.integers(0, 30, 500), rng.integers(30, 60, 500), rng.integers(0, 3, 500))]
        thin = hierarchy._thinned(spark.createDataFrame(rows, "a string, b string, height double").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(thin) < 100 and kruskal(map(tuple, thin)) == kruskal(rows)
