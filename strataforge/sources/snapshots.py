"""Keyed tables with snapshots: merge by key, copy on write of touched buckets, a manifest written last.

A table is a folder: ``data/<write>/bucket=<n>`` holds Parquet files, ``manifest/version=<v>``
one file that names, for every bucket, the write it is read from, and the schema. A row's
bucket is the hash of its key modulo a count fixed at creation. ``merge`` reads and rewrites
only the buckets that hold a key of the new rows; a version exists once its manifest does,
which is one file moved into place, so a write that dies leaves the version before. One
writer at a time: of two that start from one version, the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


MANIFEST = "key array<string>, buckets int, places map<int, string>, fields string"


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, version long").parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    rows = _manifests(spark, path)
    row = (rows.filter(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version"))).first()
    if row is None:
        raise ValueError(f"{path} has no version {version}")
    return row.asDict()


def _publish(spark: SparkSession, path: str, version: int, key: list[str], buckets: int, places: dict[int, str], schema: StructType) -> int:
    row = spark.createDataFrame([(key, buckets, places, schema.json())], MANIFEST)
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version}")
    return version


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: list[str], buckets: int) -> tuple[str, list[int]]:
    """Write rows by bucket; a bucket larger than a partition is split, small ones share a task. Gives the write and its buckets."""
    write = uuid.uuid4().hex
    where = f"{path}/data/{write}"
    rows.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(where)
    written = rows.sparkSession.read.schema(StructType.fromDDL("bucket int")).parquet(where)
    return write, sorted(r["bucket"] for r in written.select("bucket").distinct().collect())  # at most ``buckets``


def _once(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``, then by all other columns."""
    rest = [c for c in rows.columns if c not in key]
    rank = F.struct(*order, *(c for c in rest if c not in order))
    best = rows.groupBy(*key).agg(F.max(rank).alias("__best"))
    return best.select(*(F.col(c) if c in key else F.col(f"__best.{c}").alias(c) for c in rows.columns))


def create(rows: DataFrame, path: str, key: list[str], buckets: int = 64, order: list[str] | None = None) -> int:
    """A table of ``rows``, one a key, as version 0. About a gigabyte a bucket keeps merges cheap.

    Of repeated keys the greatest row by ``order`` stays; null is a key like any other. Other
    columns than the key must have an order, so maps must be in arrays of entries.
    """
    _named(rows, key)
    rows = _once(rows, key, order or [])
    write, found = _write(rows, path, key, buckets)
    return _publish(rows.sparkSession, path, 0, key, buckets, dict.fromkeys(found, write), rows.schema)


def _named(rows: DataFrame, key: list[str]) -> None:
    missing = [c for c in key if c not in rows.columns]
    if missing or "bucket" in rows.columns:
        raise ValueError(f"key columns missing: {missing}" if missing else "a column may not be named bucket")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at a version, the newest unless one is given; columns added later are null in rows not touched since."""
    m = _manifest(spark, path, version)
    return _rows(spark, path, m, sorted(m["places"]))


def _rows(spark: SparkSession, path: str, m: dict, buckets: list[int]) -> DataFrame:
    schema = StructType.fromJson(json.loads(m["fields"]))
    paths = [f"{path}/data/{m['places'][b]}/bucket={b}" for b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(new: DataFrame, path: str, insert: bool = True, update: bool = True, order: list[str] | None = None) -> int:
    """Merge rows by key and give the new version: columns that ``new`` has replace, others stay; unknown keys are added.

    Without ``insert`` unknown keys are left out, without ``update`` known rows stay as they
    are (insert if absent). Repeating a merge changes nothing. ``new`` is written once before,
    so that it is computed once; no rows, no new version. A known column must keep its type.
    """
    spark = new.sparkSession
    m = _manifest(spark, path, None)
    key, buckets, old_schema = m["key"], m["buckets"], StructType.fromJson(json.loads(m["fields"]))
    _named(new, key)
    for f in new.schema:
        if f.name in old_schema.names and old_schema[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {old_schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    staged, touched = _write(_once(new, key, order or []), path, key, buckets)
    if not touched:
        return m["version"]
    fresh = spark.read.schema(new.schema).parquet(*(f"{path}/data/{staged}/bucket={b}" for b in touched))
    old = _rows(spark, path, m, [b for b in touched if b in m["places"]])
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), fresh.withColumn("__new", F.lit(True)).alias("b")
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.join(b, same, "full" if insert else "left")
    take = F.col("b.__new").isNotNull() & (F.lit(True) if update else F.col("a.__old").isNull())
    names = [*old_schema.names, *(c for c in new.columns if c not in old_schema.names)]
    columns = []
    for c in names:
        before = F.col(f"a.{c}") if c in old_schema.names else F.lit(None)
        columns.append((F.when(take, F.col(f"b.{c}")).otherwise(before) if c in new.columns else before).alias(c))
    result = joined.select(*columns)
    write, found = _write(result, path, key, buckets)
    places = m["places"] | dict.fromkeys(found, write)
    return _publish(spark, path, m["version"] + 1, key, buckets, places, result.schema)


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, n_buckets, n_writes): the versions of a table and how many writes each is read from."""
    rows = _manifests(spark, path)
    return rows.select("version", F.size("places").alias("n_buckets"), F.size(F.array_distinct(F.map_values("places"))).alias("n_writes"))
