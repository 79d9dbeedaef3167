"""Sources as DataFrames: guideline texts, repositories, archives, analysis documents, bibliographies."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as X
from ..plans.agents import ARTIFACT

#: Nesting of archives, members of one archive, and bytes of a member that are read.
DEPTH, MEMBERS, MEMBER_BYTES = 3, 100_000, 50 * 1024 * 1024
MEMBER_SCHEMA = "artifact string, path string, size long, content binary, status string"


def guidelines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, id, name, year, size, text) of every ``*.md`` below ``folder``; unnamed ones have null parts."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    number, name, year = P.guideline_parts("path")
    null = lambda c: F.when(c != "", c)
    return rows.select("path", null(number).alias("id"), null(name).alias("name"), year.alias("year"), "size", "text")


def validated(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the ``*.md`` and ``*.txt`` files of a folder that hold something; an error if none does."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,txt}").load(folder).filter("length > 0").select("path", F.col("length").alias("size"))
    if rows.isEmpty():
        raise ValueError(f"no .md or .txt file with content in {folder}")
    return rows


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, text) of the files of a list, blank ones left out."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.filter(F.col("text").rlike(r"\S"))


def last_of_each(rows: DataFrame, key: str = "name", order: str = "path") -> DataFrame:
    """Of rows with one key the last in order of path; rows without a key go."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.filter(F.col(key).isNotNull()).withColumn("__n", rank).filter("__n = 1").drop("__n")


def repository(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, category, language, reason) of every file below ``folder`` outside excluded directories; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    rows = rows.filter(~P.excluded("path"))
    return rows.select("path", "size", P.category("path").alias("category"), P.language("path").alias("language"), P.skip_reason("path", "size").alias("reason"))


def sampled(rows: DataFrame, compat: bool = False, most: int = 10, others: int = 3, max_kb: int = 2048) -> DataFrame:
    """Files of each directory in order of name: important ones, ``most`` of allowed kinds, ``others`` of the rest.

    With ``compat`` the scan of a directory ends at the last allowed file it takes, so
    important files after that are lost.
    """
    rows = rows.filter(F.col("size") <= max_kb * 1024).withColumn("__dir", P.parent("path")).withColumn("__name", P.name("path"))
    allowed = P.is_code("path") | P.is_documentation("path") | P.is_config_or_build("path") | P.is_license("path")
    kind = F.when(P.is_important("path"), "important").when(allowed, "allowed").otherwise("other")
    rows = rows.withColumn("__kind", kind)
    place = F.row_number().over(Window.partitionBy("__dir", "__kind").orderBy("__name"))
    rows = rows.withColumn("__place", place)
    kept = (F.col("__kind") == "important") | ((F.col("__kind") == "allowed") & (F.col("__place") <= most)) | ((F.col("__kind") == "other") & (F.col("__place") <= others))
    out = rows.filter(kept)
    if compat:
        before = Window.partitionBy("__dir").orderBy("__name").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__seen", F.coalesce(F.sum((F.col("__kind") == "allowed").cast("int")).over(before), F.lit(0))).filter(F.col("__seen") < most).drop("__seen")
    return out.drop("__dir", "__name", "__kind", "__place")


def lines_of(content: Column | str) -> Column:
    """Non-blank lines of bytes read as UTF-8, bad bytes left out."""
    content = F.col(content) if isinstance(content, str) else content
    return X.filled_lines(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")))


def text_of(content: Column | str) -> Column:
    """Bytes as UTF-8, else as Latin-1; null stays empty."""
    content = F.col(content) if isinstance(content, str) else content
    text = content.cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1")), F.lit(""))


def _bounded(stream: IO[bytes]) -> bytes:
    """What a stream gives, but no more than one byte beyond ``MEMBER_BYTES``, whatever it says of its size."""
    return stream.read(MEMBER_BYTES + 1)


def members(name: str, data: IO[bytes], size: int, depth: int = 1) -> Iterator[tuple[str, int, bytes | None, str]]:
    """(path, size, content, status) of the members of an archive read from a stream that can seek, nested archives opened in place."""
    low = name.lower()
    try:
        if low.endswith(".zip"):
            found = ((i.filename, i.file_size, (lambda i=i, z=z: _bounded(z.open(i))), not i.is_dir()) for z in [zipfile.ZipFile(data)] for i in z.infolist())
        elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")):
            tar = tarfile.open(fileobj=data)  # noqa: SIM115
            found = ((i.name, i.size, (lambda i=i: i.linkname.encode() if i.issym() else _bounded(tar.extractfile(i))), i.isfile() or i.issym()) for i in tar)
        elif low.endswith((".gz", ".bz2", ".xz")):
            opened = _bounded({"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[low.rpartition(".")[2]](data))
            found = iter([(name.rpartition(".")[0], len(opened), lambda: opened, True)])
        else:
            yield name, size, None, "unsupported"
            return
        for k, (path, length, read, real) in enumerate(found):
            if not real:
                continue
            if k >= MEMBERS:
                yield path, length, None, "too many members"
                return
            clean = posixpath.normpath(path.replace("\\", "/"))
            if clean.startswith(("/", "..")):
                yield path, length, None, "unsafe path"
            elif length > MEMBER_BYTES:
                yield clean, length, None, "too large"
            else:
                try:
                    body = read()
                except Exception as e:  # noqa: BLE001  one bad member does not end the archive
                    yield clean, length, None, f"unreadable: {type(e).__name__}"
                    continue
                if len(body) > MEMBER_BYTES:
                    yield clean, len(body), None, "too large"
                elif depth < DEPTH and clean.lower().endswith(P.ARCHIVES):
                    for inner, n, content, status in members(posixpath.basename(clean), io.BytesIO(body), len(body), depth + 1):
                        yield f"{clean}/{inner}", n, content, status
                else:
                    yield clean, length, body, "ok"
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, lzma.LZMAError, zlib.error) as e:
        yield name, size, None, f"broken: {type(e).__name__}"


def archives(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(artifact, path, size, content, status) of the members of all archives below ``folder``; ``suffix`` filters paths.

    A broken, unsafe, too large or unsupported member or archive is a row with a status and no content.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(P.is_archive("path"))

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                base = posixpath.basename(path)
                out = [(base, *m) for m in members(base, io.BytesIO(content), len(content)) if m[3] != "ok" or m[0].lower().endswith(suffix)]
                yield pd.DataFrame(out, columns=["artifact", "path", "size", "content", "status"])

    return rows.select("path", "content").mapInPandas(expand, MEMBER_SCHEMA)


def analysis_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of analysis JSON files: one row per artifact; a file that does not parse is a failure row."""
    from pyspark.sql import types as T

    schema = T.StructType([*ARTIFACT.fields, T.StructField("_corrupt", T.StringType())])
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = whole.select(F.col("_metadata.file_path").alias("file"), parsed.alias("d")).select("file", "d.*")
    rows = rows.withColumn("artifact_name", F.coalesce("artifact_name", F.regexp_extract("file", r"([^/]+)\.json$", 1)))
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null").select("file", F.lit("not an analysis document").alias("error"))


def criteria(spark: SparkSession, path: str | None) -> DataFrame:
    """(dimension, raw_score, normalized_weight) from a criteria file, or the built-in table where none is given."""
    from ..plans.agents import WEIGHTS

    if path is None:
        return spark.createDataFrame([(k, w) for k, w in WEIGHTS.items()], "dimension string, normalized_weight double")
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("structured_criteria").alias("c")).select("c.dimension", F.col("c.normalized_weight").cast("double").alias("normalized_weight"))


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(key, author, title, year, publisher, url, abstract, keywords) of every entry of ``.bib`` files; absent fields are null."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^@")).alias("entry")).filter("trim(entry) <> ''")

    def field(name: str) -> Column:
        found = F.regexp_extract("entry", rf"(?is)\b{name}\s*=\s*[{{\"](.*?)[}}\"]\s*,?\s*\n", 1)
        return F.when(found != "", found).alias(name)

    return whole.select(F.regexp_extract("entry", r"^\w+\{([^,]*),", 1).alias("key"), *map(field, ("author", "title", "year", "publisher", "url", "abstract", "keywords")))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Venue profiles as ``sinks.profiles`` writes them."""
    return spark.read.schema("name string, category string, emphasis map<string, double>, top_emphasis string, style string, text_length long, n_guidelines long, threshold double, generated timestamp").json(path)
