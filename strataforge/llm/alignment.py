"""Alignment of two tokenizers over a corpus by segment deduplication.

Texts are split before runs of white space, at characters of which the two vocabularies show that
no token of either reaches across; so a segment has the same tokens alone as in its text.  Every
distinct segment is tokenised and aligned once, its alignment is joined back to the
blocks of documents that hold it, and documents are composed from their segments.

A document's bytes are cut where a token of A or B ends.  Each piece lies in one token of A and one
of B, so pieces are exactly the links (token occurrences that overlap), and a group ends
with a piece that ends both.  An alignment is the list of its pieces as integers: A id, B id, and
two bits for whether the piece ends its A and its B token.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import discard, partitions, release, scratch, share, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters before which texts may be split, and what counts as white space beside them.
SPLITS, BLANK = " \n\t\r", r"\s▁"
#: Bytes of text of a block of documents (a longer text has a block of its own), segments of a row of its dictionary,
#: alignments that a task gathers before it packs them by block, segments of documents counted and bytes of text cut at a time.
BLOCK, ROW, GATHER, COUNT, SOME = 1 << 25, 1 << 12, 1 << 18, 1 << 19, 1 << 21


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each of the integers, low ones first, and how many bytes each takes."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(end - size)[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The integers of ``packed``."""
    if not len(data):
        return np.empty(0, np.int64)
    last = data < 128
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), start)


def _binaries(values: list[np.ndarray]) -> pa.Array:
    """A binary of packed integers for each array."""
    data, size = packed(np.concatenate(values) if values else np.empty(0, np.int64))
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)]
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _integers(column: pa.ChunkedArray, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of binaries, and how many each row has."""
    rows = [np.frombuffer(v, np.uint8) for v in column.to_pylist()]
    sizes = np.array([np.count_nonzero(r < 128) for r in rows], np.int64)
    out, place, begin = np.empty(int(sizes.sum()), kind), 0, 0
    while begin < len(rows):  # a few rows at a time: the steps on the way take many times the result
        end, held = begin + 1, len(rows[begin])
        while end < len(rows) and held + len(rows[end]) <= COUNT:
            held, end = held + len(rows[end]), end + 1
        values = unpacked(np.concatenate(rows[begin:end]))
        out[place : place + len(values)] = values
        place, begin = place + len(values), end
    return out, sizes


def _unicode_of_bytes() -> dict[str, int]:
    """Byte-level vocabularies show printable Latin-1 bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}


class Pair:
    """Two tokenizers from the bytes of their files: a byte-level BPE (A) and a sentence-piece model with byte fallback (B)."""

    def __init__(self, a: bytes, b: bytes):
        self.files = a, b

    def __reduce__(self):
        return Pair, self.files

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.files[0].decode())
        made.encode_special_tokens = True  # their strings in a text are text
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.files[1])

    @cached_property
    def bytes_a(self) -> list[bytes]:
        back = _unicode_of_bytes()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        ids = range(self.b.get_piece_size())
        return [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in ids]

    @cached_property
    def splits(self) -> str:
        """The characters of ``SPLITS`` before which no token of either vocabulary has anything but white space.

        None if A cuts texts by anything but the byte-level pattern, which never joins white space to
        what is before it, or if B does not put one space before a text.
        """
        said = json.loads(self.files[0])
        cut = said.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said.get("normalizer") and said["model"]["type"] == "BPE"
        if not plain or self.bytes_b[self.b.encode("x")[0]][:1] != b" ":
            return ""
        texts = {v.decode("utf-8", "replace") for v in (*self.bytes_a, *self.bytes_b)}
        return "".join(c for c in SPLITS if not any(re.search(rf"[^{BLANK}]{re.escape(c)}", t) for t in texts))

    @cached_property
    def pattern(self) -> re.Pattern:
        """One segment: white space, what follows, and further white space that is no place to split."""
        stop = f"(?![{re.escape(self.splits)}])" if self.splits else ""
        return re.compile(rf"[{BLANK}]*[^{BLANK}]+(?:{stop}[{BLANK}]+[^{BLANK}]*)*|[{BLANK}]+")

    @property
    def base(self) -> int:
        return len(self.bytes_b)

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each segment.  All segments begin with white space; B's are read after a letter, whose tokens go."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        if not self.splits:
            return a, self.b.encode([s[1:] for s in segments], num_threads=1)  # whole texts, to which B adds the space
        guard = len(self.b.encode("x"))
        return a, [ids[guard:] for ids in self.b.encode(["x" + s for s in segments], num_threads=1)]

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all segments, and how many each has: none where joined tokens of A or B are not the segment's bytes."""
        a, b = self.tokens(segments)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        fine = [b"".join(map(of_a, x)) == (raw := s.encode()) and b"".join(map(of_b, y)) == raw for s, x, y in zip(segments, a, b, strict=True)]
        flat = [np.array([k for ids, good in zip(side, fine, strict=True) if good for k in ids], np.int64) for side in (a, b)]
        ends = [np.cumsum(np.array([len(v) for v in table], np.int64)[ids]) if len(ids) else ids for ids, table in zip(flat, (self.bytes_a, self.bytes_b), strict=True)]
        cuts = np.union1d(*ends)
        at_a, at_b = (np.searchsorted(e, cuts) for e in ends)
        pieces = (flat[0][at_a] * self.base + flat[1][at_b]) * 4 + (ends[0][at_a] == cuts) * 2 + (ends[1][at_b] == cuts) if len(cuts) else np.empty(0, np.int64)
        past = np.searchsorted(cuts, np.cumsum([len(s.encode()) if good else 0 for s, good in zip(segments, fine, strict=True)]), "right")
        return pieces, np.diff(np.concatenate([[0], past]))


def load(folder: str = TOKENIZERS, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> Pair:
    """The pair of tokenizers of two vocabulary files, read by the driver and sent to the tasks."""
    with open(os.path.join(folder, a), "rb") as x, open(os.path.join(folder, b), "rb") as y:
        return Pair(x.read(), y.read())


class _Numbers(dict):
    """Numbers from 0 in the order of first sight."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Block:
    """A block's segments by their local numbers, and its documents as segment numbers."""

    def __init__(self, docs: pa.Table, rows: pa.Table, base: int):
        self.segments, self.lengths = _integers(docs["segments"], np.int32)
        locals_, _ = _integers(rows["local"])
        sizes, _ = _integers(rows["size"])
        self.pieces, _ = _integers(rows["pieces"])
        self.first, self.size = np.zeros(len(locals_), np.int64), np.zeros(len(locals_), np.int64)
        self.first[locals_], self.size[locals_] = np.cumsum(sizes) - sizes, sizes
        self.base = base
        self.past = np.cumsum(self.lengths)
        #: Documents that have tokens.
        self.whole = np.ones(len(self.lengths), bool)
        self.whole = (self.lengths > 0) & (self.of_documents((self.size == 0).astype(np.int64)) == 0)

    def runs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Whole documents, about ``COUNT`` segments at a time: their places, their segments, and the document of each."""
        begin = 0
        while begin < len(self.past):
            upto = int(self.past[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(self.past, upto + COUNT, "right")))
            yield slice(begin, end), self.segments[upto : int(self.past[end - 1])], np.repeat(np.arange(begin, end), self.lengths[begin:end])
            begin = end

    def of_segments(self, of_pieces: np.ndarray) -> np.ndarray:
        """Sums over each segment's pieces."""
        upto = np.concatenate([[0], np.cumsum(of_pieces)])
        return upto[self.first + self.size] - upto[self.first]

    def of_documents(self, of_segments: np.ndarray) -> np.ndarray:
        """Sums over each document's segments; 0 for those without tokens."""
        out = np.zeros(len(self.lengths), np.int64)
        for docs, segments, _ in self.runs():
            upto, past = np.concatenate([[0], np.cumsum(of_segments[segments])]), np.cumsum(self.lengths[docs])
            out[docs] = upto[past] - upto[past - self.lengths[docs]]
        return np.where(self.whole, out, 0)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs, and how many of the block's documents hold each."""
        pairs, place = np.unique(self.pieces >> 2, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        for _, segments, owner in self.runs():
            here = self.whole[owner]
            held = np.unique(owner[here] * len(self.size) + segments[here])
            doc, segment = held // max(1, len(self.size)), held % max(1, len(self.size))
            size = self.size[segment]
            at = np.repeat(self.first[segment] - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.unique(np.repeat(doc, size) * max(1, len(pairs)) + place[at])
            counts += np.bincount(both % max(1, len(pairs)), minlength=len(pairs))
        return pairs, counts

    def group_texts(self) -> list[bytes]:
        """Each segment's groups as text, every one closed by a semicolon."""
        out: list[bytes] = [b""] * len(self.size)
        order = np.argsort(self.first, kind="stable")
        words: dict[int, bytes] = {}
        for i in range(0, len(order), 1 << 15):  # segments that lie side by side
            some = order[i : i + (1 << 15)]
            begin = int(self.first[some[0]])
            pieces = self.pieces[begin : int(self.first[some[-1]] + self.size[some[-1]])]
            pair, ends_a, ends_b = pieces >> 2, (pieces >> 1) & 1, pieces & 1
            group = np.cumsum(ends_a & ends_b) - (ends_a & ends_b)
            at_a, at_b = np.flatnonzero(ends_a), np.flatnonzero(ends_b)
            ids = np.concatenate([pair[at_a] // self.base, pair[at_b] % self.base])
            side = np.concatenate([group[at_a] * 2, group[at_b] * 2 + 1])  # of each group first A's, then B's
            place = np.argsort(side, kind="stable")
            ids, side = ids[place], side[place]
            sign = np.where(np.append(side[1:] != side[:-1], True), side % 2 + 1, 0)[: len(ids)]
            texts = []
            for k in (ids * 3 + sign).tolist():
                if k not in words:
                    words[k] = f"{k // 3}{',|;'[k % 3]}".encode()
                texts.append(words[k])
            upto = np.concatenate([[0], np.cumsum(ends_a + ends_b)])
            first = self.first[some] - begin
            for n, x, y in zip(some.tolist(), upto[first].tolist(), upto[first + self.size[some]].tolist(), strict=True):
                out[n] = b"".join(texts[x:y])
        return out


def align(docs: DataFrame, pair: Pair | None = None, keep_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and (unless left out) groups of each row of ``docs``.

    Of a text, a space and the text are encoded by A, and the text by B, which adds the space.  Groups are
    cut where tokens of both end; links are the pairs of token occurrences that overlap in
    bytes; a pair of ids counts the documents that hold it linked; n_best are links whose count is the
    highest of their A id, count_sum is the sum over links.  groups has decimal ids, ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those whose joined tokens are not their bytes, have zeros and ''
    for both texts, and count for no pair.  Every row is a document: repeated rows and null ids too.  A
    text without white space is one segment, however long.  Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    pair = load() if pair is None else pair
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared, base = share(spark, pair), pair.base

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, splits = shared().pattern.findall, bool(shared().splits)
        task, number, size, known = TaskContext.get().partitionId() << 32, 0, 0, _Numbers()
        names = ["is_doc", "block", "doc_id", "segments", "start", "dictionary"]

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(known)
            for i in range(0, len(words), ROW << 4):
                rows = [words[j : j + ROW] for j in range(i, min(len(words), i + (ROW << 4)), ROW)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), pa.array([task + number] * n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.binary()), pa.array([i + ROW * j for j in range(n)], pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            i = 0
            while i < batch.num_rows:
                rows: list[np.ndarray] = []
                begin, most = i, min(BLOCK, size + SOME)
                while i < batch.num_rows and size < most:
                    text = batch.column(1)[i].as_py()
                    parts = (find(" " + text) if splits else [" " + text]) if text else []
                    rows.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
                    size += len(text or "")
                    i += 1
                n = i - begin
                yield pa.RecordBatch.from_arrays([pa.array([True] * n), pa.array([task + number] * n, pa.int64()), batch.column(0).slice(begin, n), _binaries(rows), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string()))], names=names)
                if size >= BLOCK:
                    yield from dictionary()
                    number, size, known = number + 1, 0, _Numbers()
        if known:
            yield from dictionary()

    fields = f"is_doc boolean, block long, doc_id {kind}, segments binary, start int, dictionary array<string>"
    path = scratch(spark, "align-blocks")
    docs.select("doc_id", "text").mapInArrow(cut, fields).write.partitionBy("is_doc").parquet(path)
    blocks = spark.read.schema(fields).parquet(path)
    texts = blocks.filter("is_doc").select("block", "doc_id", "segments")
    words = blocks.filter("not is_doc").select("block", "start", F.posexplode("dictionary").alias("place", "segment")).select("segment", "block", (F.col("start") + F.col("place")).alias("local"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared()
        last: tuple = (None, np.empty(0, np.int64))
        held: list[tuple] = []

        def by_block() -> pa.RecordBatch:
            block, local, size = (np.concatenate([h[k] for h in held]) for k in range(3))
            pieces = np.concatenate([h[3] for h in held])
            order = np.argsort(block, kind="stable")
            first = np.cumsum(size) - size
            moved = size[order]
            at = np.repeat(first[order] - np.cumsum(moved) + moved, moved) + np.arange(moved.sum())
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            upto = np.concatenate([[0], np.cumsum(moved)])[cuts]
            arrays = [np.split(local[order], cuts), np.split(moved, cuts), np.split(pieces[at], upto)]
            return pa.RecordBatch.from_arrays([pa.array(block[order][np.concatenate([[0], cuts])]), *(_binaries(x) for x in arrays)], names=["block", "local", "size", "pieces"])

        for batch in batches:  # in the order of segments, so that a segment is tokenised once
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            names, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            again = names[0] == last[0]
            pieces, size = pair.align(names[1:] if again else names)
            if again:
                pieces, size = np.concatenate([last[1], pieces]), np.concatenate([[len(last[1])], size])
            last = (names[-1], pieces[len(pieces) - size[-1] :])
            first, mine = (np.cumsum(size) - size)[place], size[place]
            at = np.repeat(first - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), mine, pieces[at]))
            if sum(len(h[0]) for h in held) >= GATHER:
                yield by_block()
                held = []
        if held:
            yield by_block()

    dealt = words.repartition(partitions(spark), "segment").sortWithinPartitions("segment")
    found = written(dealt.mapInArrow(aligned, "block long, local binary, size binary, pieces binary"), "align-segments")
    release(spark)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, counts = _Block(left, right, base).pair_counts()
        return pa.table({"block": pa.array(np.full(len(pairs), left["block"][0].as_py()), pa.int64()), "pair": pairs, "count": counts})

    held = written(texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(counted, "block long, pair long, count long"), "align-pairs")
    release(spark)
    totals = held.groupBy("pair").agg(F.sum("count").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.floor(F.col("pair") / base)))
    totals = totals.select("pair", "count", (F.col("count") == best).alias("best"))
    back = held.select("block", "pair").join(totals, "pair")
    empty = F.lit(None)
    right = found.select("block", "local", "size", "pieces", empty.cast("long").alias("pair"), empty.cast("long").alias("count"), empty.cast("boolean").alias("best"))
    right = right.unionByName(back.select("block", *(empty.cast("binary").alias(c) for c in ("local", "size", "pieces")), "pair", "count", "best"))

    def composed(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.select(["pair", "count", "best"]).filter(right["pair"].is_valid())
        block = _Block(left, right.select(["local", "size", "pieces"]).filter(right["local"].is_valid()), base)
        known, count, best = pairs["pair"].to_numpy(), pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
        order = np.argsort(known)
        known, count, best = known[order], count[order], best[order]
        pieces = block.pieces
        sums = {  # one at a time
            "n_a": lambda: (pieces >> 1) & 1,
            "n_b": lambda: pieces & 1,
            "n_groups": lambda: pieces & (pieces >> 1) & 1,
            "n_links": lambda: np.ones(len(pieces), np.int64),
            "n_best": lambda: best[np.searchsorted(known, pieces >> 2)],
            "count_sum": lambda: count[np.searchsorted(known, pieces >> 2)],
        }
        out = {"doc_id": left["doc_id"]} | {k: block.of_documents(block.of_segments(v())) for k, v in sums.items()}
        words = block.group_texts()
        digests, groups = [], []
        past = 0
        for n, whole in zip(block.lengths.tolist(), block.whole.tolist(), strict=True):
            text = b"".join([words[k] for k in block.segments[past : past + n].tolist()])[:-1] if whole else b""
            past += n
            digests.append(hashlib.sha256(text).hexdigest() if whole else "")
            groups.append(text.decode() if keep_groups else None)
        return pa.table(out | {"groups_sha256": pa.array(digests, pa.string()), "groups": pa.array(groups, pa.string())})

    columns = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    result = texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(composed, columns)
    return result if keep_groups else result.drop("groups")
