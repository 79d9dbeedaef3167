"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are lowered (A-Z and the accented letters of Latin-1) and stripped of ASCII punctuation at their ends.  One pass
counts the benchmark's words over all documents.  From each word of an item the
seed is the shortest n-gram, of ``SHORTEST`` to ``LONGEST`` words, that documents of
independent words would hold at most ``BY_CHANCE`` times; as the corpus grows,
seeds get longer and chance hits do not.  Rarity is judged by word counts and not
by the n-gram's own, so a passage leaked thousands of times is still found.

A second pass finds the seeds in every document by a hash lookup and aligns the
words around them with the whole item.  No text is shuffled.  The benchmark is a
stated query set: it goes to the executors in blocks of at most ``BLOCK_WORDS``
words, however many blocks that takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ASCII_LOWER, U64, Words, mix, ragged, text_slices, word_prefix
from .workspace import share

SHORTEST, LONGEST = 2, 8
BY_CHANCE = 0.5
#: Points of a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score, as a share of that of an exact copy of the item.
THRESHOLD = 0.5
#: Words on either side of the place a seed predicts, as a share of the item's.
SLACK = 0.3
#: Benchmark words that one block broadcasts (24 bytes each, and each word starts one seed).
BLOCK_WORDS = 1 << 20
_FILTER_BITS = 20


def _bare_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = ASCII_LOWER[data]
    # A-grave to thorn (UTF-8 C3 80 to C3 9E, but for the multiplication sign) are lowered as well
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[latin] += 0x20
    words = Words(data, offsets).bare()
    return words.hashes(), words.bounds


class Lookup:
    """Sorted hashes behind a bit filter: which of many values are among them, and where."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[values >> U64(64 - _FILTER_BITS)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of found values, their numbers among the sorted ones)."""
        at = np.flatnonzero(self.filter[values >> U64(64 - _FILTER_BITS)])
        number = np.searchsorted(self.values, values[at])
        number[number == len(self.values)] = 0
        found = self.values[number] == values[at]
        return at[found], number[found]


class Items:
    """Word hashes of the benchmark's items, end to end."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        column = pa.array(texts, pa.large_string())
        parts = [_bare_hashes(data, offsets) for _, _, data, offsets in text_slices(column)]
        self.ids = ids
        self.words = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, U64)
        counts = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.empty(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.vocabulary = np.unique(self.words)

    def seeds(self, counts: np.ndarray, total: int) -> dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]:
        """By length: lookup of the seeds, and for each the range of its places among (item, word) places."""
        share = np.log(np.maximum(counts, 1) / max(total, 1))[np.searchsorted(self.vocabulary, self.words)]
        running = np.concatenate([[0.0], np.cumsum(share)])
        item, at = ragged(np.diff(self.bounds))
        begin, left = self.bounds[item] + at, self.bounds[item + 1] - self.bounds[item] - at
        length = np.zeros(len(begin), np.int64)
        for n in range(LONGEST, SHORTEST - 1, -1):
            fits = left >= n
            rare = np.log(max(total, 1)) + running[np.minimum(begin + n, len(share))] - running[begin] <= np.log(BY_CHANCE)
            length[fits & (rare | (n == LONGEST))] = n
        whole = (at == 0) & (left < LONGEST) & (length == 0)  # an item too short to be rare is its own seed
        length[whole] = left[whole]
        prefix = word_prefix(self.words)
        out = {}
        for n in np.unique(length[length > 0]):
            mine = np.flatnonzero(length == n)
            value = mix(prefix.spans(begin[mine], begin[mine] + n) + U64(n))
            order = np.argsort(value, kind="stable")
            values, first = np.unique(value[order], return_index=True)
            out[int(n)] = (Lookup(values), np.append(first, len(mine)), item[mine][order], at[mine][order])
        return out


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the place past its last word in ``words``."""
    steps = -GAP * np.arange(len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == word, MATCH, MISMATCH))
        above = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def _hits(seeds: dict, items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, past the last) of the best alignment of each pair at or over the threshold."""
    hashes, bounds = _bare_hashes(data, offsets)
    prefix = word_prefix(hashes)
    places, item_of, item_at = [], [], []
    for n, (lookup, ranges, item, at) in seeds.items():
        if len(hashes) < n:
            continue
        here = np.arange(len(hashes) - n + 1)
        place, number = lookup.find(mix(prefix.spans(here, here + n) + U64(n)))
        which, k = ragged(ranges[number + 1] - ranges[number])
        places.append(place[which]), item_of.append(item[ranges[number][which] + k]), item_at.append(at[ranges[number][which] + k])
    if not places or not sum(map(len, places)):
        return []
    place, item_of, item_at = np.concatenate(places), np.concatenate(item_of), np.concatenate(item_at)
    text = np.searchsorted(bounds, place, "right") - 1
    order = np.lexsort((place - item_at, item_of, text))
    out, windows = [], []
    for i in order:
        size = int(items.bounds[item_of[i] + 1] - items.bounds[item_of[i]])
        slack = int(size * SLACK) + 2
        begin = max(int(bounds[text[i]]), int(place[i] - item_at[i]) - slack)
        end = min(int(bounds[text[i] + 1]), int(place[i] - item_at[i]) + size + slack)
        if windows and windows[-1][:2] == [text[i], item_of[i]] and begin <= windows[-1][3] - slack:
            windows[-1][3] = max(windows[-1][3], end)
        else:
            windows.append([text[i], item_of[i], begin, end])
    for t, k, begin, end in windows:
        item = items.words[items.bounds[k] : items.bounds[k + 1]]
        score, past = align(item, hashes[begin:end])
        share = score / (MATCH * len(item))
        if share >= THRESHOLD:
            row = (int(t), int(k), share, begin - int(bounds[t]), begin + past - int(bounds[t]))
            if out and out[-1][:2] == row[:2]:
                out[-1] = max(out[-1], row, key=lambda r: r[2])
            else:
                out.append(row)
    return out


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of about ``BLOCK_WORDS`` words."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + size // (5 * BLOCK_WORDS)
    for part in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id").collect()
        yield Items([r[0] for r in mine], [r[1] for r in mine])


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word stands in all documents, and how many words they have."""
    spark = docs.sparkSession
    shared = share(spark, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared())
        sums, total = np.zeros(len(lookup.values), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                hashes, _ = _bare_hashes(data, offsets)
                total += len(hashes)
                sums += np.bincount(lookup.find(hashes)[1], minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(sums[some], total))], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per benchmark word
    sums, total = np.zeros(len(vocabulary), np.int64), 0
    for word, n in rows:
        if word < 0:
            total = n
        else:
            sums[word] = n
    return sums, total


def _searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Callable]:
    """For each block of the benchmark a function from a slice of texts to its hits (with item ids)."""
    spark = docs.sparkSession
    for items in _blocks(benchmark):
        if not len(items.words):
            continue
        counts, total = _counts(docs, items.vocabulary)
        shared = share(spark, (items, items.seeds(counts, total)))

        def search(data: np.ndarray, offsets: np.ndarray, shared=shared) -> list[tuple[int, int, float, int, int]]:
            items, seeds = shared()
            return [(t, items.ids[k], *rest) for t, k, *rest in _hits(seeds, items, data, offsets)]

        yield search


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): documents that hold an item or an edited copy of it.

    score is the best local alignment's, as a share of an exact copy's; words are
    counted without those of punctuation only.  Null or empty texts and items match
    nothing; repeated rows are found each; extra columns are ignored.  Without
    items or documents there are no rows.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    for search in _searchers(docs, benchmark):

        def find(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, data, offsets in text_slices(batch.column(1)):
                    rows = search(data, offsets)
                    ids = batch.column(0).take(pa.array([i + r[0] for r in rows], pa.int64()))
                    columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(find, out.schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns kept."""
    text = docs.columns.index("text")
    for search in _searchers(docs, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, data, offsets in text_slices(batch.column(text)):
                    clean[[i + r[0] for r in search(data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
