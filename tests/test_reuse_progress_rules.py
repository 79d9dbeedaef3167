"""Reuse over triggers and restarts, progress that equals the result, user rules from SQL."""

import time

import pytest
from pyspark.sql import functions as F

from strataforge.functions import rules as X
from strataforge.streaming import progress as P
from strataforge.streaming import reuse as U


def test_reuse_over_triggers(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    schema = "artifact string, path string, content string"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        U.work(spark.readStream.schema(schema).parquet(source), "content", out, checkpoint)  # a new query each time, as after a restart

    def got(trigger):
        rows = spark.read.parquet(out).filter(F.col("trigger") == trigger).collect()
        return sorted((r["artifact"], r["path"]) for r in rows)

    arrive(("a", "1", "x"), ("b", "2", "x"), ("c", "3", None))
    assert got(0) == [("a", "1"), ("b", "2"), ("c", "3")]
    arrive(("a", "4", "x"), ("a", "5", "y"), ("c", "6", ""), ("d", "7", "x"))
    assert [got(n) for n in range(1, spark.read.parquet(out).agg(F.max("trigger")).first()[0] + 1) if got(n)] == [[("a", "5"), ("d", "7")]]
    before = spark.read.parquet(out).count()
    arrive(("a", "8", "y"), ("b", "9", "x"))
    assert spark.read.parquet(out).count() == before


def test_counts_equal_the_result(spark, sf):
    said = []
    p = P.Progress(lambda *row: said.append(row))
    docs = p.stage(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "read", F.col("doc_id") % 10 == 0)
    some = p.stage(docs.filter("doc_id % 2 = 0"), "even")
    result = some.groupBy("source").count().collect()
    got = {r["stage"]: (r["n_rows"], r["n_errors"]) for r in p.counts(spark).collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet")
    assert got == {"read": (n.count(), n.filter("doc_id % 10 = 0").count()), "even": (sum(r["count"] for r in result), 0)}
    for _ in range(100):
        if len(said) == 2:
            break
        time.sleep(0.1)
    assert sorted(said) == [("even", *got["even"]), ("read", *got["read"])]
    with pytest.raises(ValueError, match="two stages"):
        p.stage(docs, "read")


def test_tasks_while_a_plan_runs(spark):
    def slow(parts):
        for part in parts:
            time.sleep(0.5)
            yield part

    def run():
        spark.sparkContext.setJobGroup("watched", "a slow plan")
        spark.range(0, 8, 1, 8).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()

    from pyspark import InheritableThread

    t = InheritableThread(target=run)
    t.start()
    seen = []
    while t.is_alive():
        seen += P.tasks(spark, "watched")
        time.sleep(0.01)
    t.join()
    seen += P.tasks(spark, "watched")
    assert any(done == total for _, total, done, _ in seen) and all(failed == 0 for *_, failed in seen)


def test_stream_progress(spark, tmp_path, sf):
    listener = P.StreamProgress()
    spark.streams.addListener(listener)
    try:
        spark.range(50).write.parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("even", F.count_if(F.expr("id % 2 = 0")).alias("n"))
        rows.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if any(t[1] for t in listener.triggers):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(t[1] for t in listener.triggers) == 50 and listener.triggers[0][2] == {"even": {"n": 25}} and not listener.errors


def test_user_rules(spark):
    X.register_rules(spark, {"words": lambda t: len(t.split()), "inverse": lambda t: 1 / len(t)})
    spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("user_texts")
    got = spark.sql("SELECT * FROM apply_rules(TABLE(user_texts), text => 'body')").collect()
    assert sorted((r["id"], r["rule"], r["value"], (r["error"] or "").partition(":")[0]) for r in got) == [
        (1, "inverse", 1 / 3, ""), (1, "words", 2.0, ""), (2, "inverse", None, "ZeroDivisionError"), (2, "words", 0.0, ""), (3, "inverse", None, "ZeroDivisionError"), (3, "words", 0.0, ""),
    ]
    one = spark.sql("SELECT * FROM apply_rules(TABLE(user_texts) PARTITION BY id, text => 'body', rules => 'words')")
    assert one.columns == ["id", "rule", "value", "error"] and one.count() == 3
    for bad, said in (("text => 'none'", "no column none"), ("text => 'body', rules => 'gone'", "unknown rules: gone")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM apply_rules(TABLE(user_texts), {bad})")


def test_views_and_text_queries(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "artifact string, n int")
    got = X.ask(spark, "SELECT sum(n) AS n FROM user_files WHERE artifact = :which", {"user_files": rows}, which="a")
    assert got.first()["n"] == 3
    X.view(spark, "files_of", "which STRING", "n INT", "SELECT n FROM user_files WHERE artifact = which")
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM files_of('a')").collect()) == [1, 2]
    assert X.ask(spark, "SELECT nothing FROM nowhere", lenient=True).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        X.ask(spark, "SELECT nothing FROM nowhere")
    assert X.ask(spark, "SELECT :x AS x", x="'; DROP").first()["x"] == "'; DROP"
