"""WARC archives and an index of captures, merged from sorted runs by a loser tree.

Every record is a gzip member of its own, and an archive is closed when its members
reach ``ARCHIVE_BYTES``; Spark's text writer puts each archive, one row, into a file on
whatever file system the shared folder is (so names end in ``.txt``).  Reading unzips
one member after the other.  Each archive gives one run of index rows, sorted by URL key
and time, each with the file, offset and length of its record.  Runs are cut at range
boundaries of (URL key, time, page), which splits even one URL's history, and every
range merges its pieces of all runs with a loser tree.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import checked_broadcast, partitions, scratch

#: Least payload of which a second copy is written as a revisit.
REVISIT_BYTES = 1000
#: Bytes at which an archive is closed; only a record that is larger by itself makes a larger one.
ARCHIVE_BYTES = 32 << 20
#: Time of page 0; each page is captured a second after the one before.
EPOCH = 1_704_067_200
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "archive string, place long, urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _record_id(page: Column, digest: Column) -> Column:
    text = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(record): the WARC record of every page, without the line breaks after it.

    Of payloads of at least ``REVISIT_BYTES`` bytes that are equal, those of the largest
    page_id are responses and the others revisits of it; a null page_id is the
    smallest.  The payload is hashed where it is read; the groups, one narrow row
    each, are joined back (broadcast if few, else by a shuffle that Spark splits
    where one payload is hot).
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    groups = rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy(F.col("digest").alias("g")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = checked_broadcast(groups.filter("n > 1").select("g", "first"))
    rows = rows.join(groups, F.col("digest") == F.col("g"), "left")
    again = F.col("g").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    captured = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + EPOCH), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    head = [
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", captured),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(again, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(again, _record_id(F.col("first"), F.col("digest")))),
        line("X-Refers-To-Page", F.when(again, F.col("first").cast("string"))),
        line("X-Page", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ]
    return rows.select(F.concat(*head).alias("record"))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per archive, without its last byte: a gzip member ends in the highest byte of its size.

    That byte is 0 for less than 16 MB; after a larger record an empty member is added.
    The writer's line separator puts the 0 back.
    """

    def closed(members: list[bytes]) -> pa.RecordBatch:
        if members[-1][-1]:
            members.append(_member(b""))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["archive"])

    members, size = [], 0
    for batch in batches:
        for record in batch.column(0).cast(pa.binary()):
            members.append(_member(record.as_py() + END.encode()))
            size += len(members[-1])
            if size >= ARCHIVE_BYTES:
                yield closed(members)
                members, size = [], 0
    if members:
        yield closed(members)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write every page's record to WARC files below ``path``, a gzip member a record."""
    made = records(pages).mapInArrow(_archives, "archive binary").select(F.col("archive").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last one, then path and query, in lower case."""
    if not url:
        return ""
    host, cut, rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.lower()).partition("/")
    return ",".join(reversed(host.split("."))) + ")" + cut + rest


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each member of an archive, one unzipped at a time; a damaged one raises ValueError."""
    at, end, view = 0, END.encode(), memoryview(content)
    while at < len(view):
        one = zlib.decompressobj(31)
        parts, fed = [], at
        try:
            while not one.eof and fed < len(view):
                parts.append(one.decompress(view[fed : fed + (1 << 16)]))
                fed += 1 << 16
        except zlib.error as e:
            raise ValueError(f"no gzip member at byte {at}") from e
        if not one.eof:
            raise ValueError(f"member at byte {at} is cut off")
        past = min(fed, len(view)) - len(one.unused_data)
        record = b"".join(parts)
        if record:
            head, _, rest = record.partition(end)
            lines = head.decode().split("\r\n")
            header = dict(line.split(": ", 1) for line in lines[1:])
            if not lines[0].startswith("WARC/") or len(rest) != int(header["Content-Length"]) + len(end) or not rest.endswith(end):
                raise ValueError(f"member at byte {at} is no whole record")
            yield at, past - at, header, rest[: -len(end)]
        at = past


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of index rows per archive; payloads are hashed again and must match their headers."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            name = path.as_py()
            for offset, length, header, block in parse(content.as_buffer()):
                http, _, payload = block.partition(END.encode())
                size, digest = int(http.rpartition(b": ")[2]), header["WARC-Payload-Digest"].removeprefix("sha1:")
                if header["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):  # noqa: S324
                    raise ValueError(f"{path}: payload of page {header.get('X-Page')} is damaged")
                page, first = header.get("X-Page"), header.get("X-Refers-To-Page")
                rows.append((url_key(header.get("WARC-Target-URI")), header["WARC-Date"], int(page) if page else None, size, digest, header["WARC-Type"], int(first) if first else None, name, offset, length))
            rows.sort(key=_order)
            columns = list(zip(*rows, strict=True)) or [()] * 10
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["archive", "place", "urlkey", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"],
            )


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, the winner goes up; one path is replayed a row."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [self._next(i) for i in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._build(1) if runs else -1

    def _next(self, i: int) -> tuple:
        row = next(self.runs[i], None)
        return (1,) if row is None else (0, _order(row), i, row)

    def _build(self, node: int) -> int:
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self.heads[a][:3] <= self.heads[b][:3] else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[self.winner][0] == 0:
            yield self.heads[self.winner][3]
            win = self.winner
            self.heads[win] = self._next(win)
            node = (win + k) // 2
            while node:
                rival = self.losers[node]
                if self.heads[rival][:3] < self.heads[win][:3]:
                    self.losers[node], win = win, rival
                node //= 2
            self.winner = win


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key range, in order of (archive, place): merged in key order."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        names = batch.column(0).to_pylist()
        for archive, *row in zip(names, *(batch.column(k).to_pylist() for k in range(2, batch.num_columns)), strict=True):
            runs.setdefault(archive, []).append(tuple(row))
    merged = list(LoserTree([iter(rows) for rows in runs.values()]))
    for i in range(0, len(merged), 4096):
        columns = zip(*merged[i : i + 4096], strict=True)
        kinds = list(schema)[2:]
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], names=[k.name for k in kinds])


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """(urlkey, captured, page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, length) of all records below ``path``.

    Globally ordered by URL key, time and page: partition by partition, and within each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    runs = files.mapInArrow(_index, _SCHEMA)
    ranged = runs.repartitionByRange(partitions(spark), "urlkey", "captured", F.asc_nulls_first("page_id")).sortWithinPartitions("archive", "place")
    return ranged.mapInArrow(_merge, _SCHEMA.removeprefix("archive string, place long, "))


def archived(pages: DataFrame) -> DataFrame:
    """Write every row of ``pages`` to WARC archives in the shared folder and return their capture index.

    A null html is an empty payload, a null url has no key; rows that repeat the
    page_id of a response are responses too; extra columns are ignored.  No rows
    give no records.  Memory is bounded by an archive and one record, however long.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return capture_index(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM g
"""
