"""Minimax contiguous partition of atomic groups into shards, in DataFrame operations.

Groups are equal texts, ordered by a 60-bit key of their MD5.  The smallest
feasible shard capacity is binary-searched with a greedy check over prefix sums.
The driver never holds the groups: it holds at most about ``BUCKETS`` sums of key
ranges.  A range of one group is atomic.  Where a cut may fall inside a range
of several, the capacity lies between that of cutting anywhere and that of never
cutting there; such ranges are split by one more aggregate until both agree, so
the capacity is exact at any size.

A group that alone sets the capacity keeps a shard to itself, and the search goes
on for the rest, so one huge group of copies does not leave other shards empty.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

SHARDS = 40
#: Bytes of a record besides its text.
EXTRA = 16
KEY_BITS = 60
#: Bound on the key ranges that the driver holds from one aggregate.
BUCKETS = 1 << 14
#: Parts of a shard whose rows are numbered side by side.
CELLS = 256


def text_key(text: str = "text") -> Column:
    """Equal texts have equal keys; null counts as the key 0."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(text)), 1, KEY_BITS // 4), 16, 10).cast("long"), F.lit(0).cast("long"))


class Ranges:
    """Key ranges in order: sizes, whether one group fills them, and the key they end at."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)  # (least key, greatest key, size, range number, bits of it)
        self.sums = [0]
        for row in self.rows:
            self.sums.append(self.sums[-1] + row[2])
        self.atomic = [row[0] == row[1] for row in self.rows]
        self.alone: list[int] = []  # ranges that have a shard to themselves

    def stretches(self) -> list[tuple[int, int]]:
        """Prefix sums between which the ranges without a shard of their own stand."""
        out, begin = [], 0
        for i in [*sorted(self.alone), len(self.rows)]:
            if self.sums[i] > begin:
                out.append((begin, self.sums[i]))
            if i < len(self.rows):
                begin = self.sums[i + 1]
        return out

    def cuts(self, capacity: int, anywhere: bool, most: int) -> list[int] | None:
        """Greedy ends of shards of at most ``capacity``; None if over ``most`` are needed."""
        out = []
        for begin, end in self.stretches():
            at = begin
            while at < end:
                to = min(at + capacity, end)
                i = bisect_right(self.sums, to) - 1
                if to < end and to != self.sums[i] and (self.atomic[i] or not anywhere):
                    to = self.sums[i]
                if to <= at or len(out) >= most:
                    return None
                out.append(to)
                at = to
        return out

    def least(self, shards: int, anywhere: bool) -> int:
        """Smallest capacity for which the greedy check succeeds."""
        low, high = 1, max(1, self.sums[-1])
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, anywhere, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def undecided(self, shards: int) -> list[int]:
        """Ranges of several groups that a cut may fall into; none if the capacity is known."""
        while True:
            free = shards - len(self.alone)
            low, high = self.least(free, True), self.least(free, False)
            if low < high:
                break
            sole = [i for i, row in enumerate(self.rows) if self.atomic[i] and row[2] == low and i not in self.alone]
            if not sole or free - 1 < 1 or len(self.alone) + 1 >= len(self.rows) or low * shards <= self.sums[-1]:
                return []
            self.alone.append(sole[0])
            if self.cuts(low, False, shards - len(self.alone)) is None:
                self.alone.pop()
                return []
        firm = self.cuts(high, False, free) or []
        loose = self.cuts(low, True, free) or []
        found = {i for i, whole in enumerate(self.atomic) if not whole and self.rows[i][2] > low}
        for early, late in zip(sorted(loose), sorted(self.cuts(high, True, free) or firm), strict=False):
            for i in range(max(0, bisect_right(self.sums, min(early, late)) - 1), min(len(self.rows), bisect_right(self.sums, max(early, late)))):
                if not self.atomic[i]:
                    found.add(i)
        return sorted(found or {i for i, whole in enumerate(self.atomic) if not whole})


def _sums(base: DataFrame, number: Column, bits: int) -> list[tuple[int, int, int, int, int]]:
    rows = base.groupBy(number.alias("range")).agg(F.min("key").alias("least"), F.max("key").alias("greatest"), F.sum("size").alias("size")).collect()
    return [(r["least"], r["greatest"], int(r["size"]), r["range"], bits) for r in rows]


def shard_ends(base: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> list[int]:
    """Greatest key of each shard but the last, from (key, size) rows."""
    top = buckets.bit_length() - 1
    ranges = Ranges(_sums(base, F.shiftright("key", KEY_BITS - top), top))
    while split := ranges.undecided(shards):
        split = split[: buckets // 4]  # the others stay for the next turn
        finer = max(2, top - len(split).bit_length())
        kept = [row for i, row in enumerate(ranges.rows) if i not in set(split)]
        for bits in sorted({ranges.rows[i][4] for i in split}):
            numbers = [ranges.rows[i][3] for i in split if ranges.rows[i][4] == bits]
            inside = base.filter(F.shiftright("key", KEY_BITS - bits).isin(numbers))  # at most buckets / 4 numbers
            kept += _sums(inside, F.shiftright("key", max(0, KEY_BITS - bits - finer)), min(KEY_BITS, bits + finer))
        ranges = Ranges(kept)
    if not ranges.rows:
        return []
    free = shards - len(ranges.alone)
    ends = set(ranges.cuts(ranges.least(free, False), False, free) or [])
    ends |= {ranges.sums[i + 1] for i in ranges.alone} | {ranges.sums[i] for i in ranges.alone}
    return [ranges.rows[i][1] for i in range(len(ranges.rows) - 1) if ranges.sums[i + 1] in ends]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    Shards are contiguous in key order; equal texts (null is equal to null) share one.
    The largest shard is as small as that allows.  Slots count a shard's rows from
    0 without gaps: rows are dealt into ``CELLS`` cells by a hash of doc_id and key,
    numbered within, and shifted by the counts of the cells before, so no task
    holds a whole shard.  Rows that are equal in all columns are numbered in any order.
    A null text has size 16 and CRC-32 0.  No rows give none.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(body) + EXTRA).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), text_key().alias("key"))
    base = written(sized, "shard-base")
    ends = shard_ends(base.select("key", "size"), shards)
    number = reduce(add, [(F.col("key") > F.lit(end)).cast("int") for end in ends], F.lit(0))
    placed = base.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(CELLS)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # at most shards * CELLS rows
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "size")
    slotted = placed.withColumn("row", F.row_number().over(inner)).join(F.broadcast(shifts), ["shard", "cell"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("shift") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
