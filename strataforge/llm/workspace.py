"""Shared scratch tables and size-checked broadcasts.

Tables go below ``spark.checkpoint.dir``, which all executors and the driver
share.  Only a local session that names none gets a folder of its own; on a cluster
that is an error.  A written table cuts the lineage and outlives any executor.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (under 64 bytes a row) is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 20_000

_mine: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a local session that names none gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strataforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _mine:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/strataforge/{tag}-{uuid.uuid4().hex}"
    _mine.append((spark, path))
    return path


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no later plan reads."""
    for table in tables:
        path = table.__dict__["scratch_path"]
        _remove(table.sparkSession, path)
        _mine[:] = [x for x in _mine if x[1] != path]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; ``discard`` removes it."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["scratch_path"] = path
    return table


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans whose result is written; it does so as the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else unchanged (a shuffle join)."""
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast ``value``, whose size the caller has bounded; the result gives it on an executor.

    Objects of this library travel with their code.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list[Any] = []

    def get() -> Any:
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
