"""Merges by key: updates, inserts, repeats, nulls, new columns, what is rewritten, and a write that dies."""

import glob

import pytest
from pyspark.sql import functions as F

from strataforge.sources import snapshots as S


@pytest.fixture()
def table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(200).select(F.col("id").cast("string").alias("name"), F.lit("Artifact").alias("label"), F.lit(0.0).alias("score"))
    assert S.create(rows, path, ["name"], buckets=16) == 0
    return path


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_update_insert_repeat(spark, table):
    new = spark.createDataFrame([("7", 0.5), ("x", 0.25), (None, 0.75)], "name string, score double")
    assert S.merge(new, table) == 1
    got = {r["name"]: tuple(r)[1:] for r in S.read(spark, table).collect()}
    assert len(got) == 202
    assert (got["7"], got["8"], got["x"], got[None]) == (("Artifact", 0.5), ("Artifact", 0.0), (None, 0.25), (None, 0.75))
    before = values(S.read(spark, table))
    assert S.merge(new, table) == 2 and values(S.read(spark, table)) == before
    assert S.read(spark, table, 0).count() == 200
    with pytest.raises(ValueError, match="no version 9"):
        S.read(spark, table, 9)


def test_only_touched_buckets_are_written(spark, table):
    def places():
        return S._manifest(spark, table, None)["places"]

    before = places()
    S.merge(spark.createDataFrame([("7", 0.5)], "name string, score double"), table)
    assert sum(before[b] != w for b, w in places().items()) == 1
    assert S.history(spark, table).orderBy("version").select("n_writes").collect()[1][0] == 2
    assert S.merge(spark.createDataFrame([], "name string, score double"), table) == 1


def test_insert_if_absent_and_update_only(spark, table):
    new = spark.createDataFrame([("7", 0.5), ("x", 0.25)], "name string, score double")
    S.merge(new, table, update=False)
    got = {r["name"]: r["score"] for r in S.read(spark, table).collect()}
    assert (got["7"], got["x"], len(got)) == (0.0, 0.25, 201)
    S.merge(spark.createDataFrame([("7", 0.5), ("y", 0.25)], "name string, score double"), table, insert=False)
    got = {r["name"]: r["score"] for r in S.read(spark, table).collect()}
    assert (got["7"], "y" in got, len(got)) == (0.5, False, 201)


def test_repeated_keys_and_new_columns(spark, table):
    new = spark.createDataFrame([("7", 0.5, 1, "a"), ("7", 0.1, 2, "b"), ("7", 0.3, 2, "c")], "name string, score double, at int, note string")
    S.merge(new, table, order=["at"])
    got = {r["name"]: (r["score"], r["at"], r["note"]) for r in S.read(spark, table).collect()}
    assert got["7"] == (0.3, 2, "c") and got["8"] == (0.0, None, None) and len(got) == 200
    with pytest.raises(ValueError, match="score is double"):
        S.merge(spark.createDataFrame([("7", "high")], "name string, score string"), table)


def test_a_write_that_dies_leaves_the_version_before(spark, table, monkeypatch):
    before = values(S.read(spark, table))
    new = spark.createDataFrame([("7", 0.5), ("x", 0.25)], "name string, score double")
    with monkeypatch.context() as m:
        m.setattr(S, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            S.merge(new, table)
    broken = new.withColumn("score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        S.merge(broken, table)
    assert values(S.read(spark, table)) == before
    assert len(glob.glob(table.removeprefix("file://") + "/manifest/*")) == 1
    assert S.merge(new, table) == 1 and S.read(spark, table).count() == 201


def test_a_second_writer_is_refused(spark, table, monkeypatch):
    new = spark.createDataFrame([("7", 0.5)], "name string, score double")
    first = S._manifest(spark, table, None)
    S.merge(new, table)
    monkeypatch.setattr(S, "_manifest", lambda *a: first)
    with pytest.raises(Exception, match="(?i)already exists"):
        S.merge(new, table)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    S.create(spark.createDataFrame([], "k long, v string"), path, ["k"], buckets=4)
    assert S.read(spark, path).collect() == []
    S.merge(spark.createDataFrame([(1, "a")], "k long, v string"), path)
    assert values(S.read(spark, path)) == [(1, "a")]
