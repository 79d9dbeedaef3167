"""N-gram Jaccard join by parity sketches.

Every distinct word shingle of a text flips one bit of a long sparse bit sketch,
so the Hamming distance of two sketches never exceeds the symmetric difference
of their shingle sets.  A pair with Jaccard similarity t differs in at most
(1-t)/(1+t) of the summed sizes.  The sketch is cut into blocks, more than such
a difference can spoil, and texts that agree on a whole block meet (pigeonhole).
Sketch lengths are set per size band (half octaves of the set size; a text also
enters the band below if a partner there is large enough).

A block holds ``CROWD`` shingles or more, so that one common line does not make
texts meet.  Where that leaves few blocks, a text has several sketches under
other hash seeds, until the bound on the chance that a worst-case pair (at the
threshold, at the band's upper end) agrees on no block is below e^-``MISS``.

Texts meet in stars: each is paired with the centre of its block's group, the member
that has the least part of its blocks to itself, never with all of them.  Pairs whose
sizes and signatures (short parity sketches of a slice of the shingles, whose Hamming
distance bounds the difference from below) allow the threshold are verified on the
exact sets; the centre failed the others.  A linked pair shares ``MISS`` blocks or more
on average; it can be left apart only if in all of those the centre failed one of the
two.  Members of a star that are in different components are therefore compared by
signature, in blocks of members, if one of the two failed in at least ``OPEN`` blocks,
and what passes is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernel import ASCII_LOWER, U64, Words, grams, mix, ragged, text_slices, word_prefix
from .workspace import checked_broadcast, discard, partitions, release, written

SHINGLE = 5
#: Similarity threshold in percent.
PERCENT = 75
#: Chance of missing a worst-case pair, as a power of 1/e.
MISS = 16.0
#: Shingles in a sketch block on average, at least, at the lower end of a band.
CROWD = 3.5
#: Blocks in which a member's centres must have failed it before it is compared again.
OPEN = 2
#: Members of a star that one task verifies, give or take chance.
STAR_PART = 1024
#: Members of a block of the last comparison.
BLOCK = 4096
LINKED = f"100 * shared >= {PERCENT} * either"
#: Bits of a signature, and shingles in its slice at most, on average.
SIGNATURE, SLICE = 512, 256

_BANDS: dict[tuple[int, int], tuple[int, int]] = {}


def band_of(size: np.ndarray) -> np.ndarray:
    """Half octave of each set size: band b holds sizes from 2**(b/2) on."""
    return np.floor(2 * np.log2(np.maximum(size, 1)) + 1e-9).astype(np.int64)


def blocks(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(blocks of a sketch, sketches of a text) in a size band."""
    if (band, percent) not in _BANDS:
        low, t = 2 ** (band / 2), percent / 100
        differ = max(2 * math.sqrt(2) * low * (1 - t) / (1 + t), math.sqrt(2) * low * (1 / t - 1))
        m = max(2, math.ceil(low / CROWD))

        def chance(m: int) -> float:
            q = (1 - 1 / m) ** differ * (1 - (1 - 1 / m) ** (t * low))
            return -m * math.log1p(-q)

        while m > 64 and chance(m - m // 32) >= MISS:
            m -= m // 32
        while m > 64 and chance(m) < MISS and m < 2 * low:
            m += m // 32
        _BANDS[band, percent] = m, math.ceil(MISS / chance(m))
    return _BANDS[band, percent]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and each text's range of them.

    Letters A-Z are lowered.  A text of fewer than n words has its whole sequence
    as one shingle; one without words has none.
    """
    words = Words(data, offsets, ASCII_LOWER)
    hashes = words.hashes()
    first, past = words.bounds[:-1], words.bounds[1:]
    count = past - first
    usual = np.maximum(count - n + 1, 0)
    short = (count > 0) & (count < n)
    text, at = ragged(np.where(short, 1, usual))
    out = np.empty(len(text), U64)
    whole = short[text]
    if len(hashes):
        if len(hashes) >= n:
            out[~whole] = grams(hashes, n)[first[text[~whole]] + at[~whole]]
        t = text[whole]
        out[whole] = mix(word_prefix(hashes).spans(first[t], past[t]) + count[t].astype(U64))
    bounds = np.concatenate([[0], np.cumsum(np.where(short, 1, usual))])
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if j - i > 1:
            out[i:j].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(offsets) - 1))])


def sketch_keys(tokens: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for each non-empty sketch block of each text, in its own band and, if it reaches there, the one below.

    Sets of fewer than three shingles link with equal sets only and have no keys.
    """
    size = np.diff(bounds)
    own = band_of(size)
    real = size > 2
    reach = real & (size * percent < 100 * 2 ** (own / 2))
    texts, keys = [], []
    for band, held in ((own, real), (own - 1, reach)):
        plan = [blocks(max(int(b), 0), percent) for b in range(-1, int(own.max(initial=0)) + 1)]
        m = np.array([p[0] for p in plan], U64)[band + 1]
        times = np.where(held, np.array([p[1] for p in plan])[band + 1], 0)
        for seed in range(int(times.max(initial=0))):
            text, at = ragged(np.where(times > seed, size, 0))
            token = tokens[bounds[text] + at]
            if seed:
                token = mix(token + U64(seed * 0x9E3779B97F4A7C15 % 2**64))
            block = ((token >> U64(32)) * m[text]) >> U64(32)
            bits = mix((token & U64(0xFFFFFFFF)) + U64(0x5851F42D4C957F2D))  # a random word per sketch bit; equal bits cancel
            place = (text.astype(U64) << U64(32)) | block
            if seed:
                order = np.argsort(place, kind="stable")
                place, bits = place[order], bits[order]
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            begin = np.flatnonzero(new)
            parity = np.bitwise_xor.reduceat(bits, begin)
            text, block = (place[begin] >> U64(32)).astype(np.int64), place[begin] & U64(0xFFFFFFFF)
            texts.append(text)
            keys.append(mix(parity ^ mix((block << U64(16)) + (U64(seed) << U64(8)) + band[text].astype(U64) + U64(1))))
    if not texts:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(texts), np.concatenate(keys)


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Two short parity sketches of each set: of its shingles in its own slice of all hashes, and in half of that.

    A slice of level k is a 2**-k of all hashes; a set's own level is the least that
    leaves ``SLICE`` shingles or fewer on average.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    level = level_of(size)
    text = np.repeat(np.arange(n), size)
    hashed = mix(tokens ^ U64(0x6A09E667F3BCC909))
    out = []
    for more in (0, 1):
        inside = (hashed & ((U64(1) << (level[text] + more).astype(U64)) - U64(1))) == 0
        bit = ((hashed[inside] >> U64(32)) % U64(SIGNATURE)).astype(np.int64)
        parity = np.bincount(text[inside] * SIGNATURE + bit, minlength=n * SIGNATURE).reshape(n, SIGNATURE) & 1
        out.append(np.packbits(parity.astype(np.uint8), axis=1))
    return [row.tobytes() for row in np.concatenate(out, 1)]


def level_of(size: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / SLICE))).astype(np.int64)


def _words_of(column: pa.Array) -> np.ndarray:
    """(set, own level or the next, 64-bit word) of a column of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), 2, SIGNATURE // 64)


def may_link(size_a: np.ndarray, size_b: np.ndarray, sig_a: np.ndarray, sig_b: np.ndarray) -> np.ndarray:
    """Whether signatures leave it open that sets reach the threshold; arrays broadcast against each other.

    A linked pair differs in at most (1-t)/(1+t) of its summed sizes, and its parity
    sketches in no more bits.  Of those shingles a slice of level k > 0 holds a
    2**-k on average, and more than six deviations and eight over that with a chance
    below e^-16.
    """
    level_a, level_b = level_of(size_a), level_of(size_b)
    level = np.maximum(level_a, level_b)
    own_a, own_b = ((level == x)[..., None] for x in (level_a, level_b))
    apart = np.bitwise_count(np.where(own_a, sig_a[..., 0, :], sig_a[..., 1, :]) ^ np.where(own_b, sig_b[..., 0, :], sig_b[..., 1, :])).sum(-1, dtype=np.int64)
    most = (size_a + size_b) * (100 - PERCENT) / (100 + PERCENT)
    mean = most / 2.0**level
    fits = 100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b)
    return fits & (apart <= np.where(level == 0, most, mean + 6 * np.sqrt(mean) + 8))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with ``near``: sizes and signatures leave a link open."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            size_a, size_b = (part.column(k).to_numpy() for k in (3, 4))
            near = may_link(size_a, size_b, _words_of(part.column(5)), _words_of(part.column(6)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near)], names=[*part.schema.names, "near"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set; its keys only where a task meets the set first (a third of all rows may be one text)."""
    seen: set[int] = set()
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(2)):
            tokens, bounds = shingle_sets(data, offsets)
            size = np.diff(bounds)
            sums = np.zeros(len(tokens) + 1, U64)
            np.cumsum(mix(tokens ^ U64(0x2545F4914F6CDD1D)), out=sums[1:])
            node = mix(sums[bounds[1:]] - sums[bounds[:-1]] + size.astype(U64)).view(np.int64)
            text, key = sketch_keys(tokens, bounds)
            fresh = np.zeros(j - i, bool)
            for r in np.unique(node, return_index=True)[1]:
                if node[r] not in seen:
                    fresh[r] = True
                    seen.add(int(node[r]))
            text, key = text[fresh[text]], key[fresh[text]]
            order = np.argsort(text, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=j - i))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array(size, pa.int64()),
                    pa.array(node, mask=size == 0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64))),
                    pa.array(signatures(tokens, bounds), pa.binary()),
                ],
                names=["doc_id", "text_key", "n_shingles", "node", "keys", "sig"],
            )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, node) in order: the rows, each once, of keys that two or more sets have."""
    held = np.empty((2, 0), np.int64)
    linked = False  # the held row has the key of the one before it
    for batch in batches:
        rows = np.concatenate([held, np.stack([batch.column(k).to_numpy() for k in (0, 1)])], 1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        rows = rows[:, new]
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        before, after = np.concatenate([[linked], same]), np.concatenate([same, [False]])
        held, linked = rows[:, -1:], bool(before[-1])
        out = rows[:, :-1][:, (before | after)[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["key", "node"])
    if linked:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "node"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (a, part, role, b, met, text) in order, the centre's text (role 0) first: exact set sizes per pair."""
    centre_was, centre = None, np.empty(0, U64)
    for batch in batches:
        a, part, role, b, met = (batch.column(k).to_numpy() for k in range(5))
        for i, j, data, offsets in text_slices(batch.column(5)):
            tokens, bounds = shingle_sets(data, offsets)
            left, right, both, either, meet = [], [], [], [], []
            for r in range(i, j):
                own = tokens[bounds[r - i] : bounds[r - i + 1]]
                if role[r] == 0:
                    centre_was, centre = (a[r], part[r]), own
                    continue
                assert centre_was == (a[r], part[r]), "a star's members come after its centre"
                if right and left[-1] == a[r] and right[-1] == b[r]:
                    continue  # a repeated row
                at = np.searchsorted(centre, own)
                shared = int(np.count_nonzero(centre[np.minimum(at, len(centre) - 1)] == own)) if len(centre) else 0
                left.append(a[r]), right.append(b[r]), both.append(shared), either.append(len(centre) + len(own) - shared), meet.append(met[r])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, both, either, meet)], names=["a", "b", "shared", "either", "met"])


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, keys, sig) of every row; node names the shingle set (null if empty).

    Of equal sets that one task reads, the first alone has keys.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, node long, keys array<long>, sig binary")


def candidates(sketches: DataFrame, where: DataFrame) -> DataFrame:
    """(a, b, met, size_a, size_b, sig_a, sig_b, near), written: different sets that agree on ``met`` sketch blocks whose centre is a.

    The centre of a block's group is the member with the least part of its keys to
    itself.  Edits give a copy blocks that nobody else has, while all blocks of the text
    it was made from are shared, so one text is the centre of nearly all its copies'
    blocks, and a copy meets it alone instead of another copy in every block.
    """
    spark = sketches.sparkSession
    rows = sketches.filter("node is not null").select(F.explode("keys").alias("key"), "node")
    dealt = rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
    met = written(dealt.mapInArrow(_shared, "key long, node long"), "jaccard-met")
    release(spark)
    own = met.groupBy("node").agg(F.count("*").alias("n")).join(where, "node").select("node", "size", (1 - F.col("n") / F.col("n_keys")).alias("alone"))
    ranked = written(met.join(own, "node"), "jaccard-ranked")
    discard(met)
    centres = ranked.groupBy("key").agg(F.min(F.struct("alone", "node", "size")).alias("centre")).select("key", "centre")
    stars = ranked.join(centres, "key").select(F.col("centre.node").alias("a"), F.col("node").alias("b"), F.col("centre.size").alias("size_a"), F.col("size").alias("size_b")).filter("a <> b")
    pairs = stars.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    for x in "ab":
        pairs = pairs.join(where.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")), x)
    columns = ["a", "b", "met", "size_a", "size_b", "sig_a", "sig_b"]
    screened = pairs.select(columns).mapInArrow(_screen, "a long, b long, met long, size_a long, size_b long, sig_a binary, sig_b binary, near boolean")
    pairs = written(screened, "jaccard-pairs")
    discard(ranked)
    return pairs


def star_texts(docs: DataFrame, pairs: DataFrame, where: DataFrame) -> DataFrame:
    """(node, text) of every set that some star holds: the one shuffle of the documents' texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = nodes.join(where, "node").select("node", "rep_id", "rep_key")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    same = texts["id"].eqNullSafe(wanted["rep_id"]) & (texts["key"] == wanted["rep_key"])
    return texts.join(wanted.hint("shuffle_hash"), same).select("node", "text")


def _with_text(texts: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the text of set b."""
    return texts.join(rows.hint("shuffle_hash"), texts["node"] == rows["b"]).select(*columns, "text")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, either, met): exact sizes for pairs of sets; ``texts`` is of ``star_texts``.

    A star of many members is dealt to several tasks, each with the centre's text.
    """
    spark = texts.sparkSession
    fan = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR_PART)).cast("int").alias("parts")), "jaccard-fan")
    wide = checked_broadcast(fan.filter("parts > 1"))
    members = pairs.join(wide, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(1).alias("role"), "b", "met")
    centres = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"), F.lit(0).cast("long").alias("met"))
    rows = _with_text(texts, members.union(centres), ["a", "part", "role", "b", "met"])
    dealt = rows.repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "role", "b")
    return dealt.mapInArrow(_verify, "a long, b long, shared long, either long, met long").dropDuplicates(["a", "b"])


def _judged(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Star pairs with what failed, unseen or verified, and what is open: b failed in ``OPEN`` blocks or more."""
    good = tested.filter(LINKED).select("a", "b", F.lit(True).alias("linked"))
    rows = pairs.drop("near").join(good, ["a", "b"], "left").withColumn("failed", F.col("linked").isNull()).drop("linked")
    times = F.sum(F.when(F.col("failed"), F.col("met"))).over(Window.partitionBy("b"))  # as many rows as b has stars
    return rows.withColumn("open", F.col("failed") & (times >= OPEN))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, i, j, side, b, size, sig) in order: pairs of a member on side 0 and one on side 1 that may link."""

    def found(sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if not (sides[0] and sides[1]):
            return
        (ids, size, sig), (ids_1, size_1, sig_1) = (tuple(np.concatenate(c) for c in zip(*side, strict=True)) for side in sides)
        for k in range(0, len(ids), 32):
            part = slice(k, k + 32)
            near = may_link(size[part, None], size_1[None, :], sig[part, None], sig_1[None, :])
            x, y = np.nonzero(near & (ids[part, None] != ids_1[None, :]))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[k + x], ids_1[y])), pa.array(np.maximum(ids[k + x], ids_1[y]))], names=["a", "b"])

    place, sides = None, ([], [])
    for batch in batches:
        here = np.stack([batch.column(k).to_numpy() for k in range(4)], 1).astype(np.int64)
        ids, size, sig = batch.column(4).to_numpy(), batch.column(5).to_numpy(), _words_of(batch.column(6))
        cuts = np.concatenate([[0], np.flatnonzero((here[1:] != here[:-1]).any(1)) + 1, [len(here)]])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if place != tuple(here[i, :3]):
                yield from found(sides)
                place, sides = tuple(here[i, :3]), ([], [])
            sides[here[i, 3]].append((ids[i:j], size[i:j], sig[i:j]))
    yield from found(sides)


def _left_over(judged: DataFrame, label: DataFrame) -> DataFrame | None:
    """(a, b) that may link: members of a star that are in different components, one of the two open; None if there are none.

    One of the two is outside the star's main component: open ones there meet all
    members (half 0), others the open ones of the main component (half 1).  Members
    are dealt into blocks, and every block of one side meets every block of the other
    in some task, by signatures alone.
    """
    named = label.select(F.col("node").alias("b"), "component")
    stars = judged.groupBy("a").agg(F.max("open").alias("live"), F.first("size_a").alias("size"), F.first("sig_a").alias("sig")).filter("live")
    stars = written(stars.select("a", F.col("a").alias("b"), F.lit(False).alias("open"), "size", "sig"), "jaccard-live")
    rows = judged.join(stars.select("a"), "a", "left_semi").select("a", "b", "open", F.col("size_b").alias("size"), F.col("sig_b").alias("sig"))
    members = rows.union(stars).join(named, "b", "left").withColumn("component", F.coalesce("component", "b"))
    found = written(members.select("a", "b", "open", "size", "sig", "component"), "jaccard-found")
    counted = found.groupBy("a", "component").agg(F.count("*").alias("n"))
    main = F.max(F.struct("n", "component")).over(Window.partitionBy("a"))  # a star's components
    counted = counted.select("a", "component", (F.col("component") != main["component"]).alias("out"))
    members = written(found.join(counted, ["a", "component"]).select("a", "b", "open", "out", "size", "sig"), "jaccard-members")
    discard(stars, found)
    n = lambda condition: F.count_if(F.expr(condition))
    halves = F.array(F.struct(F.lit(0).alias("half"), n("open and out").alias("left"), F.count("*").alias("right")), F.struct(F.lit(1).alias("half"), n("out and not open").alias("left"), n("open and not out").alias("right")))
    fan = members.groupBy("a").agg(halves.alias("halves")).select("a", F.inline("halves")).filter("left > 0 and right > 0")
    fan = written(fan.select("a", "half", F.ceil(F.col("left") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("right") / BLOCK).cast("int").alias("columns")), "jaccard-fan")
    if fan.isEmpty():
        return None
    both = F.explode(F.expr("if(open and not out, array(0, 1), array(0))"))
    spread = lambda m: m.join(fan, ["a", "half"]).withColumn("hash", F.xxhash64("b"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread(members.filter("out").withColumn("half", F.expr("if(open, 0, 1)"))).select("a", "half", F.pmod("hash", "rows").cast("int").alias("i"), every("columns").alias("j"), F.lit(0).alias("side"), "b", "size", "sig")
    right = spread(members.withColumn("half", both)).select("a", "half", every("rows").alias("i"), F.pmod("hash", "columns").cast("int").alias("j"), F.lit(1).alias("side"), "b", "size", "sig")
    rows = left.union(right).select("a", (2 * F.col("i") + F.col("half")).alias("i"), "j", "side", "b", "size", "sig")
    dealt = rows.repartition(partitions(judged.sparkSession), "a", "i", "j").sortWithinPartitions("a", "i", "j", "side", "b")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def similarity_links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b, shared, either) between different shingle sets; every linked pair is joined by a chain of links.

    ``sketches``, a written table, is removed on the way.
    """
    heads = sketches.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.first("n_shingles").alias("size"), F.max(F.size("keys")).alias("n_keys"), F.first("sig").alias("sig"))
    where = written(heads.select("node", "size", "n_keys", "sig", F.col("head.doc_id").alias("rep_id"), F.col("head.text_key").alias("rep_key")), "jaccard-where")
    pairs = candidates(sketches, where)
    discard(sketches)  # the keys are by far the largest table
    release(docs.sparkSession)
    texts = written(star_texts(docs, pairs, where), "jaccard-texts")
    release(docs.sparkSession)
    tested = written(verified(texts, pairs.filter("near")), "jaccard-tested")
    judged = written(_judged(pairs, tested), "jaccard-judged")
    links = tested.filter(LINKED).select("a", "b", "shared", "either")
    if not judged.filter("open").isEmpty():
        rest = _left_over(judged, components(links))
        if rest is not None:
            rest = written(rest.withColumn("met", F.lit(0).cast("long")), "jaccard-rest")
            more = written(verified(texts, rest), "jaccard-tested")
            links = links.union(more.filter(LINKED).select("a", "b", "shared", "either"))
            discard(rest)
    discard(texts, pairs, where, judged)
    return links


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches' (doc_id, text_key, n_shingles, node), and (node, component) of every set that has links."""
    sketches = written(sketched(docs), "jaccard-sketches")
    narrow = written(sketches.select("doc_id", "text_key", "n_shingles", "node"), "jaccard-rows")
    return narrow, components(similarity_links(docs, sketches))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Texts link when 100 * |A and B| >= 75 * |A or B| over their distinct 5-word
    shingles; component_id is the smallest doc_id of a text's component.  Null or
    wordless texts have no shingles and are a component of their own row's doc_id.
    Repeated rows and equal texts share a component.  A null doc_id never names a
    component unless it has no other.  Other columns are ignored; no rows give none.
    """
    narrow, label = _labelled(docs)
    least = narrow.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = least.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("least").alias("low"))
    by_node = named.join(low, "component").select("node", "low")
    out = narrow.join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the least doc_id, null last, and of its texts the one of least hash; all columns kept.

    Rows without shingles all stay.  Of rows that agree on doc_id and text one stays.
    A doc_id that is null or stands on several texts may so stay once for each component.
    """
    keyed = docs.withColumn("__key", F.xxhash64("text")).withColumn("__words", F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]")))
    narrow, label = _labelled(docs.select("doc_id", "text"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("__id"), F.col("text_key").alias("__hash"))
    least = narrow.filter("node is not null").groupBy("node").agg(F.min(row).alias("least"))
    named = least.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select("least.__id", "least.__hash")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash"))
    first = keyed.filter("__words").join(kept.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", "__key"])
    rest = keyed.filter("not coalesce(__words, false)")
    return first.unionByName(rest).drop("__key", "__words")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT c.x AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id FROM (SELECT x, min(y) AS m FROM r GROUP BY x) c LEFT JOIN n ON c.x = n.doc_id
"""
