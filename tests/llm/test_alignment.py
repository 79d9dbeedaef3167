"""Two tokenizers aligned segment by segment, against whole texts encoded and walked in a plain loop."""

import collections
import hashlib
import random

import numpy as np
import pytest

from strataforge.llm import alignment

SCHEMA = "doc_id long, text string, block long, pair string, groups int, is_doc boolean"


@pytest.fixture(scope="module")
def pair():
    return alignment.load()


def texts():
    rng = random.Random(2)
    words = "the model reads naïve café Straße Tokenizer isn't 12345 3.14 http://x.org/a?b=c 東京都 привет 😀😀 a b x　y tail. (ok) don't’s".split(" ")
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    made += [None, "", " ", "\n", "  lead", "trail  ", "trail\n", "a  b\n\n  c\t\td \n e", "\r\nwin\r\n", "nul\x00l", "<|endoftext|> and <s> </s> <unk> <0x41>", "literal▁mark", "▁", "x ▁ y"]
    made += ["a" * 3000, "word " * 5000, "\n" * 700, "é" * 900, "q   z", "zero​ width", "\x1c sep\x85 next line", "same text twice", "same text twice"]
    return made


def walked(pair, text):
    """Ids of A and B, groups and links of a whole text, or none."""
    a, b, raw = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or ""), (" " + (text or "")).encode()
    if not text or b"".join(pair.bytes_a[k] for k in a) != raw or b"".join(pair.bytes_b[k] for k in b) != raw:
        return None
    at = [[(k, end - len(table[k]), end) for k, end in zip(ids, np.cumsum([len(table[k]) for k in ids]).tolist())] for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b))]
    both = sorted({x[2] for x in at[0]} & {x[2] for x in at[1]})
    groups, ahead = [], [0, 0]
    for end in both:
        sides = []
        for n in (0, 1):
            begin = ahead[n]
            while ahead[n] < len(at[n]) and at[n][ahead[n]][2] <= end:
                ahead[n] += 1
            sides.append(",".join(str(x[0]) for x in at[n][begin : ahead[n]]))
        groups.append("|".join(sides))
    links, first = [], 0
    for k, s, e in at[0]:
        while at[1][first][2] <= s:
            first += 1
        j = first
        while j < len(at[1]) and at[1][j][1] < e:
            links.append((k, at[1][j][0]))
            j += 1
    return a, b, groups, links


def brute_force(pair, rows):
    found = [(i, walked(pair, t)) for i, t in rows]
    count = collections.Counter(link for _, w in found if w for link in set(w[3]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, w in found:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        a, b, groups, links = w
        text = ";".join(groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest(), text))
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 17 else None, t, i, "p", 1, True) for i, t in enumerate(texts())] + [(1, texts()[1], 0, "p", 1, False)] * 2


def test_alignment_is_brute_force(spark, pair, rows):
    got = [tuple(r) for r in alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(4), pair).collect()]
    want = brute_force(pair, [r[:2] for r in rows])
    assert sum(w[7] == "" for w in want) >= 4
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_alignment_in_small_blocks(spark, pair, rows, monkeypatch):
    for name, value in (("BLOCK", 200), ("ROW", 7), ("GATHER", 50), ("COUNT", 30)):
        monkeypatch.setattr(alignment, name, value)
    got = [tuple(r) for r in alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3), pair).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_force(pair, [r[:2] for r in rows])))


def test_alignment_without_places_to_split(spark, pair, rows):
    whole = alignment.Pair(*pair.files)
    whole.__dict__["splits"] = ""
    assert whole.pattern.findall(" a b\nc  ") != pair.pattern.findall(" a b\nc  ")
    found = [whole.align([" " + t]) for t in texts()[:20]]
    parts = [pair.align(pair.pattern.findall(" " + t)) for t in texts()[:20]]
    assert all((a[0] == b[0]).all() for a, b in zip(found, parts))


def test_empty_table(spark, pair):
    assert alignment.align(spark.createDataFrame([], SCHEMA), pair).count() == 0
    none = alignment.align(spark.createDataFrame([(1, None, 0, None, 0, None)], SCHEMA), pair, keep_groups=False)
    assert [tuple(r) for r in none.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_long_text(spark, pair):
    text = " ".join(f"w{k % 991}" for k in range(250_000))  # over 1 MB
    got = alignment.align(spark.createDataFrame([(1, text, 0, None, 0, None)], SCHEMA), pair).first()
    assert tuple(got) == brute_force(pair, [(1, text)])[0]


def test_segments_hold_the_text_and_are_cut_where_no_token_reaches(pair):
    assert " " in pair.splits
    for t in texts():
        if t:
            assert "".join(pair.pattern.findall(" " + t)) == " " + t
    assert not any(v.decode("utf-8", "replace").strip() and v.decode("utf-8", "replace").rstrip(" ") != v.decode("utf-8", "replace") for v in pair.bytes_b)


def test_packing():
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(0, 1 << k, 50) for k in range(1, 62)])
    data, size = alignment.packed(values)
    assert (alignment.unpacked(data) == values).all() and size.sum() == len(data)
    assert len(alignment.unpacked(alignment.packed(np.empty(0, np.int64))[0])) == 0
