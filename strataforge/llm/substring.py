"""Substring deduplication: seed with winnowed anchors, extend both ways, keep long repeats.

A window is ``LENGTH`` consecutive words.  Winnowing gives every window one
anchor, the least of its ``ANCHOR``-word hashes (the last one among equals), so equal
windows share it wherever they stand.  Neighbouring windows with the same
anchor place form a run; its span is the anchor extended both ways as far as
those windows reach.

Occurrences meet by anchor, sorted by span, and are only ever compared with
their neighbour in that order, so a passage that a third of all texts hold
costs no more a row than any other:

* equal spans: every window of both runs repeats;
* same anchor, other span: a maximal repeat may end inside.  Only these runs are
  cut into their windows, which meet and are compared the same way.

Spans and windows are compared by 64-bit hashes of their whole word sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Words, grams, mix, ragged, text_slices, word_prefix
from .workspace import partitions

#: Words of a window: the least length of a repeat.
LENGTH = 35
#: Words of an anchor.
ANCHOR = 6


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values, the last one among equals (in all but the low bits)."""
    n = len(values)
    bits = U64(max(n, 2).bit_length())
    low = (U64(1) << bits) - U64(1)
    packed = (values & ~low) | (low - np.arange(n, dtype=U64))
    held = 1
    while held < width:
        step = min(held, width - held)
        packed = np.minimum(packed[: len(packed) - step], packed[step:])
        held += step
    return (low - (packed & low)).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(text, first window, last window, anchor hash, span hash) of each run, and the texts' Words and window hashes.

    Window numbers count from each text's first word.
    """
    words = Words(data, offsets)
    hashes = words.hashes()
    empty = np.empty(0, np.int64)
    if len(hashes) < length:
        return empty, empty, empty, empty.view(U64), empty.view(U64), words, None
    prefix = word_prefix(hashes)
    seeds = grams(hashes, anchor)
    place = _least_places(seeds, length - anchor + 1)
    bounds = words.bounds
    text, at = ragged(np.maximum(np.diff(bounds) - length + 1, 0))
    if not len(text):
        return empty, empty, empty, empty.view(U64), empty.view(U64), words, None
    window = bounds[text] + at
    here = place[window]
    new = np.ones(len(window), bool)
    new[1:] = (here[1:] != here[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(window)) - 1
    span = mix(prefix.spans(window[begin], window[last] + length) + (last - begin).astype(U64))
    return text[begin], at[begin], at[last], seeds[here[begin]], span, words, prefix


#: Added to ``more`` of a run that its own slice of texts has shown to repeat whole.
_KNOWN = 1 << 10


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every text.  Of equal ones in a slice two meet others; the rest are known to repeat and are dealt at random."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        for i, _, data, offsets in text_slices(batch.column(1)):
            text, first, last, anchor, span, _, _ = runs(data, offsets)
            more = (last - first).astype(np.int16)
            order = np.lexsort((span, anchor))
            alike = (anchor[order][1:] == anchor[order][:-1]) & (span[order][1:] == span[order][:-1])
            inner = np.zeros(len(order), bool)
            inner[order[1:-1]] = alike[:-1] & alike[1:]  # the ends of each group go on to meet others
            more[inner] += _KNOWN
            anchor = np.where(inner, mix(key[i + text].view(U64) + first.astype(U64)), anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(span.view(np.int64)), pa.array(key[i + text]), pa.array(first.astype(np.int32)), pa.array(more)],
                names=["anchor", "span", "key", "first", "more"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch], same) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order with, for each, what ``same`` says of it and the row before, and of it and the row after.

    The last row of a batch is held back until its next row is known.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        link = same(table)
        before = np.concatenate([[carry if held is not None else 0], link])
        n = table.num_rows
        if n > 1:
            yield table.slice(0, n - 1), before[: n - 1], link
        held, carry = table.slice(n - 1), before[n - 1]
    if held is not None:
        yield held, np.array([carry]), np.zeros(1, link.dtype if n > 1 else np.int8)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (anchor, span): which repeat whole, and which must be cut into windows."""

    def same(table: pa.RecordBatch) -> np.ndarray:
        anchor, span = table.column(0).to_numpy(), table.column(1).to_numpy()
        alike = anchor[1:] == anchor[:-1]
        return (alike.astype(np.int8) << 1) - (alike & (span[1:] == span[:-1]))  # 2: anchor only, 1: span too

    for table, before, after in _neighbours(batches, same):
        more = table.column(4).to_numpy()
        known = more >= _KNOWN
        whole, cut = (before == 1) | (after == 1) | known, ((before == 2) | (after == 2)) & ~known
        some = whole | cut
        yield pa.RecordBatch.from_arrays(
            [table.column(2).filter(pa.array(some)), table.column(3).filter(pa.array(some)), pa.array((more & (_KNOWN - 1))[some]), pa.array(whole[some]), pa.array(cut[some])],
            names=["key", "first", "more", "whole", "cut"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, text, runs to cut): a row for each of their windows."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        lists = batch.column(2)
        for i, j, data, offsets in text_slices(batch.column(1)):
            mine = lists.slice(i, j - i)
            flat = mine.flatten()
            text, at = ragged(flat.field(1).to_numpy().astype(np.int64) + 1)
            begin = flat.field(0).to_numpy().astype(np.int64)[text] + at
            text = np.repeat(np.arange(j - i), np.diff(mine.offsets.to_numpy()))[text]
            words = Words(data, offsets)
            at = words.bounds[text] + begin
            value = mix(word_prefix(words.hashes()).spans(at, at + LENGTH))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(key[i + text]), pa.array(begin.astype(np.int32))], names=["window", "key", "first"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order: those equal to the one before or after."""

    def same(table: pa.RecordBatch) -> np.ndarray:
        value = table.column(0).to_numpy()
        return (value[1:] == value[:-1]).astype(np.int8)

    for table, before, after in _neighbours(batches, same):
        twice = pa.array((before | after).astype(bool))
        first = table.column(2).filter(twice)
        yield pa.RecordBatch.from_arrays([table.column(1).filter(twice), first, pa.array(np.zeros(len(first), np.int16))], names=["key", "first", "more"])


def _cover(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    edges = np.zeros(len(words) + 1, np.int64)
    if spans:
        first = np.array([s[0] for s in spans])
        np.add.at(edges, first, 1)
        np.add.at(edges, first + np.array([s[1] for s in spans]) + LENGTH, -1)
    return words, np.cumsum(edges[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2).to_pylist()
        texts = batch.column(1).cast(pa.binary())
        total, gone, kept = [], [], []
        for text, spans in zip(texts, lists, strict=True):
            body = text.as_py() or b""
            if spans:
                words, covered = _cover(body, [(s["first"], s["more"]) for s in spans])
                left = b" ".join(compress(words, ~covered))
                total.append(len(words)), gone.append(int(covered.sum()))
            else:
                words = body.split()
                left = b" ".join(words)
                total.append(len(words)), gone.append(0)
            kept.append(left)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        sha = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, repeats) per row: the ranges of repeated windows, as array<struct<first, more>> (null: none)."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    seeds = rows.select(_key().alias("key"), "text").mapInArrow(_runs, "anchor long, span long, key long, first int, more short")
    met = seeds.repartition(n, "anchor").sortWithinPartitions("anchor", "span").mapInArrow(_met, "key long, first int, more short, whole boolean, cut boolean")
    # One exchange of the texts serves both joins below: the plans up to it are the same, so it is written once.
    dealt = rows.select(_key().alias("key"), "doc_id", "text").repartition(n, "key")
    by_text = met.groupBy("key").agg(
        F.collect_set(F.when(F.col("cut"), F.struct("first", "more"))).alias("cuts"), F.collect_set(F.when(F.col("whole"), F.struct("first", "more"))).alias("repeats")
    )
    cuts = dealt.join(by_text.filter("size(cuts) > 0").select(F.col("key").alias("k"), "cuts").hint("shuffle_hash"), F.col("key") == F.col("k")).select("key", "text", "cuts")
    windows = cuts.mapInArrow(_windows, "window long, key long, first int")
    parts = windows.repartition(n, "window").sortWithinPartitions("window").mapInArrow(_repeated, "key long, first int, more short")
    edges = parts.groupBy("key").agg(F.collect_set(F.struct("first", "more")).alias("repeats"))
    every = by_text.select("key", "repeats").union(edges).groupBy(F.col("key").alias("k")).agg(F.flatten(F.collect_list("repeats")).alias("repeats"))
    joined = dealt.join(every.hint("shuffle_hash"), F.col("key") == F.col("k"), "left")
    return joined.select("doc_id", "text", "repeats")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of repeated windows.

    A word goes if a window of 35 words that covers it also starts anywhere else, in
    the same text too; all occurrences go.  Kept words are joined by one space.
    Null texts count as empty; texts of under 35 words stay whole; repeated rows are
    occurrences of their own.  Other columns are ignored; no rows give none.
    """
    return _with_repeats(docs).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def removal_digest(docs: DataFrame) -> DataFrame:
    """As ``remove_repeats``, with the SHA-256 of the kept words' UTF-8 in place of the text."""
    return _with_repeats(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
c AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
g AS (SELECT DISTINCT r, s + o AS i FROM c, range(35) t(o)),
e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
x AS (SELECT e.r, array_to_string(list(word ORDER BY e.i), ' ') AS kept FROM e LEFT JOIN g ON e.r = g.r AND e.i = g.i WHERE g.i IS NULL GROUP BY e.r),
m AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m ON d.r = m.r LEFT JOIN x ON d.r = x.r
"""
