"""Artifacts of a folder as a data source: discovery, files and archive members as rows, one summary row per artifact.

``spark.read.format("artifacts").option("path", folder)`` gives (artifact, kind, source,
path, size, content, status). The driver lists the folder and one level of each artifact
that is a folder (names and sizes, no contents); tasks walk what lies deeper and open the
archives. Files and archives are packed into partitions by size, a subfolder counts
``FOLDER_BYTES``. Whatever cannot be read is a row with a status and no content, so a bad
artifact does not end a batch. An empty folder gives no rows, an empty artifact none of its own.

Options: ``nested`` (artifacts lie one folder deeper), ``listing`` (a JSON list of {path,
name} on one file system, instead of a folder), ``content`` (false: names and sizes only), ``suffix`` (rows of
paths that end so, and all errors), ``groupBytes``. Filters on the end of ``path`` and on
``size`` are applied while reading, also to errors.
"""

from __future__ import annotations

import json
import operator
import posixpath
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyarrow import fs as A
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import readers as R

#: Bytes of a partition, and what a folder of unknown size counts.
GROUP_BYTES, FOLDER_BYTES = 128 * 1024 * 1024, 16 * 1024 * 1024
# Suffixes of archives that stand for an artifact.
SUFFIXES = (".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz")
SCHEMA = "artifact string, kind string, source string, path string, size long, content binary, status string"
_COMPARE: dict[type, Callable[[Any, Any], bool]] = {S.GreaterThan: operator.gt, S.GreaterThanOrEqual: operator.ge, S.LessThan: operator.lt, S.LessThanOrEqual: operator.le, S.EqualTo: operator.eq}


@dataclass(frozen=True)
class Artifact:
    path: str
    name: str
    kind: str
    size: int


@dataclass(frozen=True)
class Unit:
    """What one task reads at a time: an archive, a file, or all below a folder."""

    artifact: Artifact
    path: str
    kind: str
    size: int


class Group(S.InputPartition):
    def __init__(self, units: list[Unit]) -> None:
        super().__init__(units)
        self.units = units


def opened(path: str) -> tuple[A.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return A.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (A.LocalFileSystem(), path)


def _level(store: A.FileSystem, path: str) -> list[A.FileInfo]:
    return sorted(store.get_file_info(A.FileSelector(path)), key=lambda i: i.path)


def _is_folder(info: A.FileInfo) -> bool:
    return info.type == A.FileType.Directory


def _stem(name: str) -> str:
    return posixpath.splitext(name)[0] or name


def _archives(level: list[A.FileInfo], prefix: str = "") -> list[Artifact]:
    return [Artifact(i.path, prefix + _stem(i.base_name), "archive", i.size) for i in level if i.type == A.FileType.File and i.base_name.lower().endswith(SUFFIXES)]


def discover(folder: str, nested: bool = False) -> list[Artifact]:
    """Artifacts of a folder in order of path: archives, and folders that are not hidden.

    With ``nested`` each folder's archives, named ``folder_stem``; a folder without any is an
    artifact itself if it holds a file.
    """
    store, root = opened(folder)
    level = _level(store, root)
    folders = [i for i in level if _is_folder(i) and not i.base_name.startswith(".")]
    if not nested:
        found = [*_archives(level), *(Artifact(i.path, i.base_name, "directory", 0) for i in folders)]
        return sorted(found, key=lambda a: a.path)
    found = []
    for folder_info in folders:
        inside = _level(store, folder_info.path)
        packed = _archives(inside, folder_info.base_name + "_")
        if not packed and any(i.type == A.FileType.File for i in inside):
            packed = [Artifact(folder_info.path, folder_info.base_name, "directory", 0)]
        found += packed
    return found


def listed(text: str) -> list[Artifact]:
    """Artifacts of a JSON list of {path, name}, once a path; one that is missing is kept and gives an error row."""
    found: dict[str, Artifact] = {}
    for entry in json.loads(text):
        store, path = opened(entry["path"])
        info = store.get_file_info(path)
        name = entry.get("name") or (posixpath.basename(path) if _is_folder(info) else _stem(posixpath.basename(path)))
        kind = "directory" if _is_folder(info) else "missing" if info.type == A.FileType.NotFound else "archive"
        found.setdefault(path, Artifact(path, name, kind, info.size or 0))
    return list(found.values())


def _units(store: A.FileSystem, a: Artifact) -> Iterator[Unit]:
    if a.kind != "directory":
        yield Unit(a, a.path, a.kind, a.size)
        return
    try:
        level = _level(store, a.path)
    except OSError:
        yield Unit(a, a.path, "missing", 0)
        return
    for i in level:
        yield Unit(a, i.path, "folder", FOLDER_BYTES) if _is_folder(i) else Unit(a, i.path, "file", i.size)


def packed(units: Iterable[Unit], most: int) -> list[list[Unit]]:
    """Units in order, cut where a group would pass ``most`` bytes; a larger unit is a group of its own."""
    groups: list[list[Unit]] = []
    total = most + 1
    for u in units:
        if total + u.size > most:
            groups.append([])
            total = 0
        groups[-1].append(u)
        total += u.size
    return groups


class Reader(S.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.listing = options.get("path"), options.get("listing")
        if not self.root and not self.listing:
            raise ValueError("artifacts: a path or a listing is needed")
        entries = json.loads(self.listing) if self.listing else []
        self.where = entries[0]["path"] if entries else self.root or "."
        self.nested, self.content = (options.get(k, d).lower() == "true" for k, d in (("nested", "false"), ("content", "true")))
        self.suffix, self.most = options.get("suffix", ""), int(options.get("groupbytes", options.get("groupBytes", GROUP_BYTES)))
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[S.Filter]) -> Iterable[S.Filter]:  # noqa: N802
        for f in filters:
            if (isinstance(f, S.StringEndsWith) and f.attribute == ("path",)) or (type(f) in _COMPARE and getattr(f, "attribute", ()) == ("size",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[S.InputPartition]:
        found = listed(self.listing) if self.listing else discover(self.root, self.nested)
        store, _ = opened(self.where)
        return [Group(g) for g in packed((u for a in found for u in _units(store, a)), self.most)]

    def _wanted(self, path: str, size: int | None) -> bool:
        for column, kind, value in self.tests:
            if column == "path" and not path.endswith(value):
                return False
            if column == "size" and (size is None or not _COMPARE[kind](size, value)):
                return False
        return True

    def read(self, partition: S.InputPartition) -> Iterator[tuple]:
        store, _ = opened(self.where)
        for u in partition.units if isinstance(partition, Group) else ():
            a = u.artifact
            try:
                for path, size, content, status in self._rows(store, u):
                    if (status != "ok" or path.lower().endswith(self.suffix)) and self._wanted(path, size):
                        yield a.name, a.kind, a.path, path, size, content if self.content else None, status
            except Exception as e:  # noqa: BLE001  one bad artifact does not end the batch
                if self._wanted(u.path, None):
                    yield a.name, a.kind, a.path, u.path, None, None, f"failed: {type(e).__name__}"

    def _rows(self, store: A.FileSystem, u: Unit) -> Iterator[tuple[str, int | None, bytes | None, str]]:
        if u.kind == "missing":
            yield u.path, None, None, "missing"
        elif u.kind == "archive":
            with store.open_input_file(u.path) as stream:
                yield from R.members(posixpath.basename(u.path), stream, u.size)
        elif u.kind == "file":
            yield self._file(store, u, u.path, u.size)
        else:
            for i in store.get_file_info(A.FileSelector(u.path, recursive=True)):
                if i.type == A.FileType.File:
                    yield self._file(store, u, i.path, i.size)

    def _file(self, store: A.FileSystem, u: Unit, path: str, size: int) -> tuple[str, int, bytes | None, str]:
        inner = posixpath.relpath(path, u.artifact.path)
        if not self.content or not (inner.lower().endswith(self.suffix) and self._wanted(inner, size)):
            return inner, size, None, "ok"
        if size > R.MEMBER_BYTES:
            return inner, size, None, "too large"
        try:
            with store.open_input_file(path) as stream:
                return inner, size, stream.read(), "ok"
        except OSError as e:
            return inner, size, None, f"unreadable: {type(e).__name__}"


class ArtifactSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> S.DataSourceReader:
        return Reader(dict(self.options))


def artifacts(spark: SparkSession, folder: str | None = None, **options: str) -> DataFrame:
    """Rows of the source ``artifacts``, registered in the session with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArtifactSource)
    reader = spark.read.format("artifacts").options(**options)
    return reader.option("path", folder).load() if folder else reader.load()


def intake(rows: DataFrame) -> DataFrame:
    """(artifact, kind, n_files, bytes, n_failed, success, error): one row per artifact; it fails if nothing in it could be read.

    ``error`` is the least status of what was not read, null if all was.
    """
    good = F.col("status") == "ok"
    per = rows.groupBy("artifact", "kind", "source").agg(
        F.count_if(good).alias("n_files"), F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~good).alias("n_failed"), F.min(F.when(~good, F.col("status"))).alias("error")
    )
    return per.select("artifact", "kind", "n_files", "bytes", "n_failed", (F.col("n_files") > 0).alias("success"), "error")


def batch_report(taken: DataFrame) -> DataFrame:
    """(total, successful, failed, success_rate, bytes) of a batch's intake; the rate of no artifacts is 0."""
    done = F.count_if("success")
    return taken.agg(F.count("*").alias("total"), done.alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.round(F.try_divide(done * 100.0, F.count("*")), 6), F.lit(0.0)).alias("success_rate"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
