"""Queries that do more than their registered SQL, against brute force."""

from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np

from strataforge.plans import queries


def test_shared_neighbours_are_whole_parts(spark, sf):
    sold = defaultdict(set)
    for part, nation in duckdb.sql(f"SELECT l_partkey, s_nationkey::VARCHAR FROM '{sf}/lineitem.parquet' JOIN '{sf}/supplier.parquet' ON l_suppkey = s_suppkey").fetchall():
        sold[part].add(nation)
    shared = Counter(p for nations in sold.values() for p in combinations(sorted(nations), 2))
    got = {(r["a"], r["b"]): r["shared"] for r in queries.gq23_shared_neighbours(spark, sf).collect()}
    assert got and got == {p: n for p, n in shared.items() if n >= 2}


def test_every_stated_query_is_searched(spark, sf):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        near = sorted((-round(float(c), 9), int(v)) for v, c in zip(ids, x @ x[i], strict=True) if v != ids[i])[:5]
        want |= {(int(ids[i]), rank, v) for rank, (_, v) in enumerate(near, 1)}
    got = [(r["query"], r["rank"], r["vec_id"]) for r in queries.srt07_vector_top_k(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
