import numpy as np
from pyspark.sql import functions as F

from strataforge.operators import keywords as K
from strataforge.operators import similarity as V
from strataforge.operators import statistics as S
from strataforge.plans import agents as A
from strataforge.plans import patterns as P
from strataforge.plans import retrieval as R
from strataforge.streaming import events as E
from tests.test_agents import FULL, artifact


def test_predictions_and_advice(spark):
    df = spark.createDataFrame([artifact("full", **FULL), artifact("empty")], A.ARTIFACT)
    rows = P.predictions(P.scores(P.features(df))).cache()
    by = {r["artifact_name"]: r for r in rows.collect()}
    assert by["full"]["probability"] > by["empty"]["probability"] and by["empty"]["likelihood"] == "low"
    assert all(0 <= by[a][f"{k}_score"] <= 1 for a in by for k in P.SCORES)
    advice = {(r["artifact_name"], r["advice"]) for r in P.recommendations(rows).collect()}
    assert ("empty", "Add a comprehensive README file explaining the project") in advice and ("full", "Add a comprehensive README file explaining the project") not in advice
    table = P.indicators(rows, F.col("artifact_name") == "full")
    fit = {r["artifact_name"]: r["similarity"] for r in P.alignment(rows, table).collect()}
    assert fit == {"full": 1.0, "empty": 0.0}
    moved = {r["artifact_name"]: r["adjusted"] for r in P.adjusted(rows, P.alignment(rows, table)).collect()}
    assert moved["full"] >= by["full"]["probability"] and moved["empty"] <= by["empty"]["probability"]
    assert P.summary(rows).count() == 5


def test_correlation_of_constants_is_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 5.0), (3.0, None, 5.0)], "y double, x double, c double")
    got = {r["feature"]: (r["r"], r["strength"]) for r in S.correlations(df, "y", ["x", "c"]).collect()}
    assert got == {"x": (1.0, "strong"), "c": (0.0, "weak")}
    assert S.basic(df.limit(0), "x").first()["mean"] == 0.0


def test_similarity_clusters(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (3, 0, [0.0, 1.0]), (4, 1, [0.1, 0.9]), (5, 1, [-1.0, 0.0])], "k long, d int, v array<double>")
    links = V.keyword_links(vectors, "k", "d", "v", 0.7)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(1, 2), (3, 4)}
    assert {r["node"]: r["cluster"] for r in V.clusters(links, "a", "b").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    top = V.top_k(vectors, "k", "v", vectors.filter("k = 1"), 2).orderBy("rank").collect()
    assert [r["k"] for r in top] == [2, 4]


def test_tfidf_has_unit_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "")], "doc long, text string")
    rows = K.tfidf(K.terms(docs, "doc", "text", 2), "doc", most=1.0)
    assert all(abs(r[1] - 1) < 1e-9 for r in rows.groupBy("doc").agg(F.sum(F.col("tfidf") * F.col("tfidf"))).collect())
    assert "beta beta" in {r["term"] for r in rows.collect()}


def test_retrieval_and_providers(spark):
    nodes = spark.createDataFrame([("a", "Section", "Install", "x"), ("b", "Dependency", "numpy", "x"), ("c", "File", "f", "x")], "id string, label string, name string, artifact string")
    edges = spark.createDataFrame([("a", "DEPENDS_ON", "b"), ("b", "REQUIRES", "c"), ("c", "DEPENDS_ON", "b"), ("b", "CONTAINS", "a")], "src string, type string, dst string")
    hits = R.graph_hits(edges, nodes, "setup", 5)
    assert [(r["key"], r["score"]) for r in hits.collect()] == [("b", 3.0)]
    found = R.retrieve("setup", spark.createDataFrame([("c", 0.9)], "key string, score double"), hits, 2).collect()
    assert found[0]["key"] == "b"
    asked = R.prompts(R.section_context(nodes), "{artifact}: {context}")
    assert R.generated(asked).first()["text"].startswith("x: {")
    assert R.generated(asked, lambda p: 1 / 0).first()["text"] == "[not generated: ZeroDivisionError]"
    row = spark.createDataFrame([('ok {"score": 0.5, "justification": "j"}',), ("no",)], "t string").select(R.reply("t").alias("r")).collect()
    assert row[0]["r"]["score"] == 0.5 and (row[1]["r"] is None or row[1]["r"]["score"] is None)


def test_stream_reads_only_what_is_new(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        q = E.upserts(E.arrivals(spark, str(tmp_path / "in"), "id long"), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
        q.awaitTermination()
    assert sum(seen) == 3
    spark.range(2).write.mode("append").parquet(str(tmp_path / "in"))
    E.upserts(E.arrivals(spark, str(tmp_path / "in"), "id long"), lambda df, n: seen.append(df.count()), str(tmp_path / "check")).awaitTermination()
    assert sum(seen) == 5


def test_sessions(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' ts, 1 user_id union all select timestamp'2024-01-01 00:10:00', 1 union all select timestamp'2024-01-01 02:00:00', 1")
    assert sorted(r["n"] for r in E.sessions(rows).collect()) == [1, 2]


def test_keyword_links_send_a_vector_to_a_bounded_number_of_blocks(spark, monkeypatch):
    assert V.blocks_of(51_200) == V.blocks_of(512_000) == V.MOST_BLOCKS and V.blocks_of(100) == 1
    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "SLICE", 5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    rows = [(f"k{i:03}", int(i % 4), [float(v) for v in x[i]]) for i in range(300)] + [("n", 1, None), ("z", 2, [0.0] * 5), ("h", 3, [1.0, None, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 5), ("d", None, [1.0] * 5)]
    links = V.keyword_links(spark.createDataFrame(rows, "k string, d int, v array<double>"), "k", "d", "v", 0.6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"k{i:03}", f"k{j:03}") for i in range(300) for j in range(i + 1, 300) if i % 4 != j % 4 and u[i] @ u[j] > 0.6}
    got = links.collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert all(abs(r["similarity"] - u[int(r["a"][1:])] @ u[int(r["b"][1:])]) < 1e-9 and r["dim_a"] == int(r["a"][1:]) % 4 and r["dim_b"] == int(r["b"][1:]) % 4 for r in got)
    degrees = V.degrees(links, "a", "b")
    assert sum(r["degree"] for r in degrees.collect()) == 2 * len(want)
    assert degrees._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroups") == 1
