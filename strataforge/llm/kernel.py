"""Byte-level text kernel shared by the corpus operators.

Arrow hands a whole batch of texts over as one UTF-8 buffer plus offsets.  All
functions here work on that buffer with numpy, so no Python object is made per
word.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which are
never part of a longer UTF-8 sequence.

Hashes are 64-bit polynomial prefix sums (mod 2**64) finished with an
avalanche step; a span's hash is read off two prefix sums in O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C55)
_WORD_BASE = U64(0xD1B54A32D192ED03)

SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser over uint64 (two xor-multiply rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self._steps = (int(base), inverse)
        self._base = base
        self._tables = [np.ones(1, U64), np.ones(1, U64)]

    def __reduce__(self):
        return _Powers, (self._base,)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            for k, step in enumerate(self._steps):
                table = self._tables[k]
                while len(table) < n:
                    jump = U64(pow(step, len(table), 1 << 64))
                    table = np.concatenate([table, table * jump])
                self._tables[k] = table
        return self._tables[0][:n], self._tables[1][:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


class Prefix:
    """Prefix sums of a sequence; ``spans(i, j)`` hashes items i..j-1 wherever they stand."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        up, self._down = powers.upto(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]


class Words:
    """The words of several texts: byte spans, and per text the range of word numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
        self.data = data if table is None else table[data]
        inside = ~SEPARATORS[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)  # a text begins here
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            before &= ~edge[:n]
            after &= ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def bare(self) -> Words:
        """The words without ASCII punctuation at either end; words of nothing else go."""
        plain = np.flatnonzero(~PUNCTUATION[self.data])
        first = np.searchsorted(plain, self.start)
        past = np.searchsorted(plain, self.end)
        some = past > first
        out = object.__new__(Words)
        out.data = self.data
        out.start, out.end = plain[first[some]], plain[past[some] - 1] + 1
        out.bounds = np.concatenate([[0], np.cumsum(some)])[self.bounds]
        return out

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        start, end = (self.start, self.end) if start is None else (start, end)
        sums = Prefix(self.data.astype(U64) + U64(1), _BYTE_POWERS)
        return mix(sums.spans(start, end) ^ ((end - start).astype(U64) << U64(48)))


def word_prefix(hashes: np.ndarray) -> Prefix:
    return Prefix(hashes, _WORD_POWERS)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (the last n-1 places are left out)."""
    if len(hashes) < n:
        return np.empty(0, U64)
    at = np.arange(len(hashes) - n + 1)
    return mix(word_prefix(hashes).spans(at, at + n) + U64(n))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range by itself."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, bytes, offsets) for each slice of a column."""
    data, offsets = text_buffers(column)
    for i, j in slices(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: each member's group and its number within it."""
    counts = np.asarray(counts, dtype=np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - begin[group]
