"""Tables written to the folder all executors share, to cut a plan or to use a result twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a session on one machine that names none gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strataforge/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends there, and a lost executor costs nothing that was done."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["kept_path"] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Remove what ``kept`` wrote and no later plan reads; other tables stay."""
    for table in tables:
        if path := table.__dict__.get("kept_path"):
            spark = table.sparkSession.sparkContext
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark removes the shuffle files of each query that has ended, such as one that ``kept`` writes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
