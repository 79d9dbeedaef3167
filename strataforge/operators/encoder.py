"""Word and text vectors from the corpus itself: positive pointwise mutual information, factored by a randomised range finder.

Nothing but small square matrices (``DIMENSIONS`` + ``SPARE`` wide) and numbers reach the driver's Python.  Words become numbers
first; pairs are counted in the tasks before they are shuffled, once for both directions, as arrays of numbers in tiles of the
matrix (``BLOCK`` words a side); thin matrices are a row a block.  Any table (word, vector, weight) can stand in for ``fit``'s.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .tables import dropped, kept, unshuffled

DIMENSIONS, SPARE, POWERS = 32, 8, 4
#: Words on each side that count as context, least occurrences of a word, words of whole texts that are numbered at a time.
WINDOW, LEAST, CHUNK = 4, 5, 1 << 18
#: Words of whole texts that meet their vectors at a time.
PIECE = 1 << 19
#: Words of a block, pairs that a task counts at a time, pairs of a group before and in a product after they are added up, pairs of a row.
BLOCK, COUNTED, GROUP, TILE, ROW = 1 << 17, 1 << 23, 1 << 22, 1 << 24, 1 << 18
#: Pairs of a product below which more tasks are not worth it.
SMALL = 1 << 19
#: Words a side of a cell, least share of pairs in one that is multiplied as a dense matrix, pairs that a product takes at a time.
CELL, DENSE, SLAB = 1 << 10, 3e-3, 1 << 22
#: Words up to which the numbers of words are broadcast to the places; beyond, both are shuffled.
NUMBERED = 1_000_000
#: Words up to which the vocabulary is broadcast to the counted pairs; beyond, both are shuffled.
BROADCAST_WORDS = 3_000_000
#: A word of share p of all words weighs COMMON / (COMMON + p) in a text.
COMMON = 1e-3


class Counts(NamedTuple):
    """``pairs``: (tile, a, b, n) arrays of pairs of numbers, a <= b; ``words``: (id, word, own), own being the sum of a word's counts."""

    pairs: DataFrame
    words: DataFrame
    total: int
    blocks: int


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _places(words: DataFrame, window: int) -> DataFrame:
    """(piece, word, at): where each word stands in a piece, some whole texts with gaps between them."""
    chunk = CHUNK

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(0)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // chunk)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(size)], strict=True):
                values = lists.slice(i, j - i).flatten()
                if not len(values):
                    continue
                coded = values.dictionary_encode()
                which = coded.indices.to_numpy()
                at = np.arange(len(which)) + window * np.repeat(np.arange(j - i), size[i:j])
                order, ends = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), piece)), coded.dictionary, _lists(np.r_[0, ends], at[order].astype(np.int32))], names=["piece", "word", "at"])
                piece += 1

    return words.mapInArrow(split, "piece long, word string, at array<int>")


def _numbers(piece: pa.Table) -> pa.Table:
    """The numbers of a piece's words in order, -1 for a gap or an unknown word."""
    lists = piece["at"].combine_chunks()
    at = lists.flatten().to_numpy()
    ids = np.full(at.max() + 1, -1, np.int32)
    ids[at] = np.repeat(piece["id"].to_numpy(), lists.value_lengths().to_numpy())
    return pa.table({"ids": _lists(np.array([0, len(ids)]), ids)})


def _added(group: pa.Table) -> pa.Table:
    """Equal pairs of a group added up, at most ``ROW`` pairs a row."""
    lo, hi, n = (group[c].combine_chunks().flatten().to_numpy() for c in ("a", "b", "n"))
    code = lo.astype(np.int64) << 32 | hi
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    n, code = np.add.reduceat(n[order], first), code[first]
    ends = np.r_[np.arange(0, len(code), ROW), len(code)]
    key = pa.array(np.full(len(ends) - 1, group["tile"][0].as_py()))
    return pa.table({"tile": key, "a": _lists(ends, (code >> 32).astype(np.int32)), "b": _lists(ends, code.astype(np.int32)), "n": _lists(ends, n)})


def counted(docs: DataFrame, text: str, window: int = WINDOW, least: int = LEAST) -> Counts:
    """How often two words stand at most ``window`` words apart.

    Words with fewer than ``least`` occurrences are no words here but keep their places.  Null texts have no words.
    """
    with unshuffled(docs.sparkSession):
        places = kept(_places(docs.select(tokens(text).alias("w")), window), "places")  # words are split once; a filter on them would do it again
        known = kept(places.groupBy("word").agg(F.sum(F.size("at")).alias("all")).filter(F.col("all") >= least), "known")
        size, occurrences = known.agg(F.count("*"), F.coalesce(F.sum("all"), F.lit(0))).first()
        ids = kept(known.rdd.map(lambda r: r[0]).zipWithIndex().toDF("word string, id long").withColumn("id", F.col("id").cast("int")), "vocabulary")
        blocks = max(1, -(-size // BLOCK))
        slices = max(1, 2 * window * occurrences // (GROUP * blocks * (blocks + 1)))
        pieces = kept(places.join(F.broadcast(ids) if size <= NUMBERED else ids, "word").groupBy("piece").applyInArrow(_numbers, "ids array<int>"), "pieces")
        dropped(places)
        block, most = BLOCK, COUNTED

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def grouped(held: list[np.ndarray]) -> pa.RecordBatch:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                lo, hi = code >> 32, code & 0xFFFFFFFF
                group = (lo // block * blocks + hi // block) * slices + (lo + hi) % slices
                order = np.argsort(group, kind="stable")
                keys, starts = np.unique(group[order], return_index=True)
                ends = np.r_[starts, len(order)]
                return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys // slices), _lists(ends, lo[order].astype(np.int32)), _lists(ends, hi[order].astype(np.int32)), _lists(ends, n[order])], names=["group", "tile", "a", "b", "n"])

            held, n = [], 0
            for batch in batches:
                for piece in batch.column(0):
                    ids = piece.values.to_numpy()
                    for o in range(1, window + 1):
                        a, b = ids[:-o], ids[o:]
                        fine = (a >= 0) & (b >= 0)
                        a, b = a[fine].astype(np.int64), b[fine].astype(np.int64)
                        held.append(np.minimum(a, b) << 32 | np.maximum(a, b))
                        n += len(a)
                    if n >= most:
                        yield grouped(held)
                        held, n = [], 0
            if n:
                yield grouped(held)

        rows = pieces.mapInArrow(count, "group long, tile long, a array<int>, b array<int>, n array<long>")
        pairs = kept(rows.groupBy("group").applyInArrow(_added, "tile long, a array<int>, b array<int>, n array<long>"), "cooccurrences")
        dropped(pieces, known)
        ends = _single(pairs).select(F.explode(F.array(F.struct(F.col("a").alias("id"), "n"), F.struct(F.col("b").alias("id"), "n"))).alias("e")).select("e.*")
        words = kept(ids.join(ends.groupBy("id").agg(F.sum("n").alias("own")), "id").select("id", "word", "own"), "words")
        dropped(ids)
        return Counts(pairs, words, words.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0], blocks)


def _single(pairs: DataFrame) -> DataFrame:
    """(a, b, n), a row a pair."""
    return pairs.select(F.inline(F.arrays_zip("a", "b", "n")))


def cooccurrences(docs: DataFrame, text: str, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(word, context, n, own, others, total): ``counted`` both ways round, with the sums of each word's counts and of all."""
    counts = counted(docs, text, window, least)
    words = F.broadcast(counts.words) if counts.words.count() <= BROADCAST_WORDS else counts.words
    left = words.select(F.col("id").alias("a"), F.col("word").alias("x"), F.col("own").alias("own_x"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("y"), F.col("own").alias("own_y"))
    way = lambda x, y, n: F.struct(F.col(x).alias("word"), F.col(y).alias("context"), n.alias("n"), F.col(f"own_{x}").alias("own"), F.col(f"own_{y}").alias("others"))
    n = F.col("n")
    both = F.when(F.col("a") == F.col("b"), F.array(way("x", "y", n * 2))).otherwise(F.array(way("x", "y", n), way("y", "x", n)))
    return _single(counts.pairs).join(left, "a").join(right, "b").select(F.inline(both)).withColumn("total", F.lit(counts.total))


def associations(counts: DataFrame) -> DataFrame:
    """(word, context, n, ppmi) of the pairs that stand together more often than chance, from ``cooccurrences``."""
    ppmi = F.ln(F.col("n") * F.col("total") / (F.col("own").cast("double") * F.col("others")))
    return counts.select("word", "context", "n", ppmi.alias("ppmi")).filter("ppmi > 0")


_THIN = "block int, v array<double>"


def _matrix(row: pa.Scalar, width: int) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _flat(v: np.ndarray) -> pa.ListArray:
    return _lists(np.array([0, v.size]), np.ascontiguousarray(v, np.float64).ravel())


def _products(pairs: DataFrame, width: int) -> np.ndarray:
    """X' Y over rows (x, y) of two thin matrices: added up in the tasks, then by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                total += _matrix(x, width).T @ _matrix(y, width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    out = np.zeros(width * width)
    for cell, v in pairs.select("x", "y").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    return out.reshape(width, width)


def _mapped(thin: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(block, v) with each row's vectors changed."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, v in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), _flat(change(_matrix(v, width)))], names=["block", "v"])

    return thin.select("block", "v").mapInArrow(apply, _THIN)


def _orthonormal(thin: DataFrame, width: int) -> DataFrame:
    """Columns with the same span, orthonormal (twice, for digits); columns without a direction become zeros."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_products(thin.select(F.col("v").alias("x"), F.col("v").alias("y")), width))
        fine = values > max(values.max(initial=0), 0) * 1e-13
        turn = vectors * np.where(fine, 1 / np.sqrt(np.where(fine, values, 1)), 0)
        before, thin = thin, kept(_mapped(thin, width, lambda v, turn=turn: v @ turn), "thin")
        dropped(before)
    return thin


def _spread(a: np.ndarray, b: np.ndarray, v: np.ndarray, xa: np.ndarray, xb: np.ndarray, ya: np.ndarray, yb: np.ndarray) -> None:
    """Adds v times xb[b] to ya[a] and v times xa[a] to yb[b]; no pair (a, b) comes twice.

    Cells with many pairs are dense matrices for a while; of the others one column after another is added up, pairs of a cell together.
    """
    across = -(-len(xb) // CELL)
    cell = a // CELL * across + b // CELL
    counts = np.bincount(cell)
    order, ends = np.argsort(cell.astype(np.uint16) if len(counts) <= 1 << 16 else cell, kind="stable"), np.cumsum(counts)
    a, b, v, rest, dense = a[order], b[order], v[order], np.ones(len(a), bool), np.zeros((CELL, CELL), np.float32)
    for c in np.flatnonzero(counts > DENSE * CELL * CELL):
        some = slice(ends[c] - counts[c], ends[c])
        i, j = c // across * CELL, c % across * CELL
        cells = dense[: len(xa) - i, : len(xb) - j]
        at = a[some] - i, b[some] - j
        cells[at] = v[some]
        ya[i : i + CELL] += cells @ xb[j : j + CELL]
        yb[j : j + CELL] += cells.T @ xa[i : i + CELL]
        cells[at] = 0
        rest[some] = False
    a, b, v = a[rest], b[rest], v[rest]
    for row, column, x, y in ((a, b, xb, ya), (b, a, xa, yb)):
        y += np.stack([np.bincount(row, line.take(column) * v, len(y)) for line in np.ascontiguousarray(x.T)], axis=1)


def _times(links: DataFrame, counts: Counts, owns: DataFrame, thin: DataFrame, width: int, spread: int) -> DataFrame:
    """The sparse matrix of associations times a thin one: each tile meets the two blocks it needs, and sums of blocks come out; ``spread`` tasks."""
    total, blocks, block_size = counts.total, counts.blocks, BLOCK
    unit = links.select("unit", F.col("part").alias("to_part")).distinct()
    sides = unit.select(F.col("unit").alias("to_unit"), F.explode(F.array_distinct(F.array(F.expr(f"cast(unit div {blocks} as int)"), F.expr(f"cast(unit % {blocks} as int)")))).alias("block"), "to_part")
    sent = sides.join(thin.join(owns, "block").select("block", "own", F.col("v").cast("array<float>").alias("v")), "block")

    def multiply(pairs: pa.Table, given: pa.Table) -> pa.Table:
        a_block, b_block = divmod(pairs["unit"][0].as_py(), blocks)
        own, x, rank = {}, {}, {}
        for block, o, v in zip(given["block"].to_pylist(), given["own"], given["v"], strict=True):
            own[block] = o.values.to_numpy(zero_copy_only=False)
            order = np.argsort(-own[block], kind="stable")  # frequent words first, as pairs crowd among them
            x[block], rank[block] = _matrix(v, width).astype(np.float32)[order], np.argsort(order).astype(np.int32)
        y = {k: np.zeros(v.shape) for k, v in x.items()}

        def add_up(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
            a, b, v = (np.concatenate(c) for c in zip(*held, strict=True))
            _spread(a, b, v, x[a_block], x[b_block], y[a_block], y[b_block])

        held, size = [], 0
        for lo, hi, n in zip(pairs["a"], pairs["b"], pairs["n"], strict=True):
            a, b, n = lo.values.to_numpy() - a_block * block_size, hi.values.to_numpy() - b_block * block_size, n.values.to_numpy().astype(np.float64)
            same = lo.values.to_numpy() == hi.values.to_numpy()
            v = np.log(np.where(same, 2 * n, n) * total / (own[a_block][a] * own[b_block][b]))
            fine = v > 0
            held.append((rank[a_block][a[fine]], rank[b_block][b[fine]], np.where(same, v / 2, v)[fine].astype(np.float32)))  # a word with itself is added both ways
            size += len(held[-1][0])
            if size >= SLAB:
                add_up(held)
                held, size = [], 0
        if size:
            add_up(held)
        out = [pa.table({"block": pa.array([k], pa.int32()), "v": _flat(v[rank[k]]).cast(pa.list_(pa.float32()))}) for k, v in y.items()]
        return pa.concat_tables(out)

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"block": group["block"].slice(0, 1), "v": _flat(sum(_matrix(v, width) for v in group["v"]))})

    made = links.repartition(spread, "unit", "part").groupBy("unit", "part").cogroup(sent.repartition(spread, "to_unit", "to_part").groupBy("to_unit", "to_part")).applyInArrow(multiply, "block int, v array<float>")
    return kept(made.groupBy("block").applyInArrow(add, _THIN), "thin")


def fit(docs: DataFrame, text: str, dimensions: int = DIMENSIONS, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(word, vector, weight): a vector for each word of at least ``least`` occurrences that has an association.

    Vectors are the leading ``dimensions`` eigenvectors of the association matrix, greatest absolute
    eigenvalue first, each times the root of that value.  Start vectors come from the words' hashes, so
    reruns agree to rounding (of single precision, as which vectors are sent).  No words give no rows.
    """
    width, size = dimensions + SPARE, BLOCK
    counts = counted(docs, text, window, least)
    total, blocks = counts.total, counts.blocks
    words = counts.words.withColumn("block", F.expr(f"id div {size}").cast("int"))

    def start(group: pa.Table) -> pa.Table:
        at = group["id"].to_numpy() % size
        own, v = np.ones(at.max() + 1), np.zeros((at.max() + 1, width))
        own[at] = group["own"].to_numpy()
        for i, w in zip(at, group["word"].to_pylist(), strict=True):
            v[i] = np.random.default_rng(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")).standard_normal(width)
        return pa.table({"block": group["block"].slice(0, 1), "own": _flat(own), "v": _flat(v)})

    with unshuffled(docs.sparkSession):
        first = kept(words.groupBy("block").applyInArrow(start, "block int, own array<double>, v array<double>"), "start")
        owns, basis = first.select("block", "own"), first.select("block", "v")
        distinct = counts.pairs.agg(F.coalesce(F.sum(F.size("a")), F.lit(0))).first()[0]
        tasks = min(-(-distinct // SMALL), docs.sparkSession.sparkContext.defaultParallelism)  # so many tasks at least
        parts = max(1, 2 * distinct // (TILE * blocks * (blocks + 1)), -(-2 * tasks // (blocks * (blocks + 1))))
        spread = 4 * parts * blocks * (blocks + 1) // 2  # few units meet in a task by their hashes; without any a task ends at once
        links = counts.pairs.select(F.col("tile").alias("unit"), F.expr(f"cast(abs(hash(a[0], b[0])) % {parts} as int)").alias("part"), "a", "b", "n")
        for k in range(1 + POWERS):
            before, basis = basis, _orthonormal(_times(links, counts, owns, basis, width, spread), width)
            if k:
                dropped(before)
        image = _times(links, counts, owns, basis, width, spread)
        core = _products(basis.select("block", F.col("v").alias("x")).join(image.select("block", F.col("v").alias("y")), "block"), width)
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[:dimensions]
        turn = vectors[:, order] * np.sqrt(np.abs(values[order]))

        def named(left: pa.Table, right: pa.Table) -> pa.Table:
            v = (_matrix(right["v"][0], width) if len(right) else np.zeros((size, width)))[left["id"].to_numpy() % size]
            fine = v.any(axis=1)
            out, own = v[fine] @ turn, left["own"].to_numpy()[fine]
            vector = _lists(np.arange(0, out.size + 1, dimensions), out.ravel())
            return pa.table({"word": left["word"].filter(pa.array(fine)), "vector": vector, "weight": pa.array(COMMON / (COMMON + own / total))})

        found = words.groupBy("block").cogroup(basis.withColumnRenamed("block", "at").groupBy("at")).applyInArrow(named, "word string, vector array<double>, weight double")
        out = kept(found, "words")
        dropped(counts.pairs, counts.words, first, basis, image)
        return out


class Piece(NamedTuple):
    """Some whole texts: ``codes`` are the rows of ``words``, ``vectors`` and ``weights`` that their words have in order, zeros for unknown words."""

    keys: pa.Array
    ends: np.ndarray
    codes: np.ndarray
    words: list[str]
    known: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray

    def texts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place in ``keys``, codes) of each text."""
        for i, (a, b) in enumerate(zip(np.r_[0, self.ends[:-1]], self.ends, strict=True)):
            yield i, self.codes[a:b]

    def summed(self, codes: np.ndarray) -> np.ndarray:
        """The weighted sum of the vectors of a text's words."""
        which, n = np.unique(codes, return_counts=True)
        return (n * self.weights[which]) @ self.vectors[which]


def met(docs: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """The words of some whole texts at a time (a piece, at most ``PIECE`` words or one text) with their vectors, as ``opened`` reads them.

    A word and its vector are sent once a piece, not once a text.  Null texts have no words.
    """
    kind, most = docs.schema[key].dataType.simpleString(), PIECE

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, lists = batch.columns
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(size)], strict=True):
                if i == j:
                    continue
                coded = lists.slice(i, j - i).flatten().dictionary_encode()
                which, found = coded.indices.to_numpy(), coded.dictionary
                order, ends = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=len(found)))
                if not len(found):
                    found, ends = pa.nulls(1, found.type), np.zeros(1, np.int64)
                first = pa.array(np.r_[0, np.full(len(ends), j - i)].astype(np.int32))  # the first row has the texts' keys and sizes
                columns = [pa.array(np.full(len(ends), piece)), found, _lists(np.r_[0, ends], order.astype(np.int32)), pa.ListArray.from_arrays(first, keys.slice(i, j - i)), pa.ListArray.from_arrays(first, pa.array(size[i:j].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=["piece", "word", "at", "keys", "sizes"])
                piece += 1

    rows = docs.select(F.col(key).alias("key"), tokens(text).alias("w")).mapInArrow(split, f"piece long, word string, at array<int>, keys array<{kind}>, sizes array<int>")
    return rows.join(words.select("word", "vector", "weight"), "word", "left")


def opened(group: pa.Table) -> Piece:
    """A piece from its rows of ``met``."""
    flat = lambda name: group[name].combine_chunks().flatten()
    at, vector = flat("at").to_numpy(), group["vector"].combine_chunks()
    codes = np.empty(len(at), np.int64)
    codes[at] = np.repeat(np.arange(len(group)), group["at"].combine_chunks().value_lengths().to_numpy())
    known = vector.is_valid().to_numpy(zero_copy_only=False)
    values = vector.flatten().to_numpy(zero_copy_only=False)
    vectors = np.zeros((len(group), len(values) // max(1, known.sum())))
    vectors[known] = values.reshape(-1, vectors.shape[1]) if known.any() else 0
    weights = group["weight"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    return Piece(flat("keys"), np.cumsum(flat("sizes").to_numpy()), codes, group["word"].to_pylist(), known, vectors, weights)


def encode(docs: DataFrame, key: str, text: str, words: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, n_words, vector): the weighted sum of a text's word vectors, of length 1; null where it has no known word."""

    def sums(group: pa.Table) -> pa.Table:
        piece = opened(group)
        n, v = np.zeros(len(piece.keys), np.int64), np.zeros((len(piece.keys), dimensions))
        for i, codes in piece.texts():
            n[i] = np.count_nonzero(piece.known[codes])
            if n[i]:
                v[i] = piece.summed(codes)
        fine = n > 0
        length = np.linalg.norm(v[fine], axis=1, keepdims=True)
        flat = pa.array((v[fine] / np.where(length, length, 1)).ravel(), mask=np.repeat(length == 0, dimensions))
        offsets = pa.array(np.r_[0, np.cumsum(fine * dimensions)].astype(np.int32))
        return pa.table({"key": piece.keys, "n_words": pa.array(n), "vector": pa.ListArray.from_arrays(offsets, flat, mask=pa.array(~fine))})

    kind = docs.schema[key].dataType.simpleString()
    return met(docs, key, text, words).groupBy("piece").applyInArrow(sums, f"key {kind}, n_words long, vector array<double>").withColumnRenamed("key", key)
