"""Mentions and containment joins against plain loops, and on hard rows."""

import random

import pytest

from strataforge.operators import mentions, substrings


def overlapping(text, name):
    return sum(text.startswith(name, i) for i in range(len(text)))


def test_mentions_by_a_plain_loop(spark):
    rng = random.Random(3)
    names = {a: [rng.choice(["run.py", "a.c", "aa", "aaa", "README", "src/", "é.py", "x y"]) for _ in range(5)] for a in range(6)}
    texts = [(a, d, " ".join(rng.choice(["run.py", "aaaa", "src/main", "readme", "README", "é.py", "x", "y", "x y"]) for _ in range(rng.randrange(0, 30)))) for a in range(7) for d in range(4)]
    texts += [(1, 90, None), (2, 91, ""), (None, 92, "run.py"), (3, 93, "aa " * 300_000), (3, 93, "aa")]
    rows = [(a, n) for a, ns in names.items() for n in ns] + [(1, None), (1, ""), (None, "run.py")]
    got = mentions.mentions(spark.createDataFrame(texts, "artifact long, document long, text string"), "artifact", "document", "text", spark.createDataFrame(rows, "artifact long, path string"), "path")
    want = []
    for a, d, t in texts:
        for n in set(names.get(a, [])):
            if t and n in t:
                want.append((a, d, n, len(t) // 3 if len(t) > 10_000 and n == "aa" else overlapping(t, n)))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_edges_of_shared_names_and_nested_folders(spark):
    files = spark.createDataFrame([(1, "src/app/main.py"), (1, "old/main.py"), (1, "/top.txt"), (2, "src/x.c"), (2, None)], "artifact long, path string")
    texts = spark.createDataFrame([(1, 7, "see src/app/main.py and top.txt"), (2, 8, "src x.c x.c"), (3, 9, "src/ main.py")], "artifact long, document long, text string")
    got = {tuple(r) for r in mentions.edges(texts, "artifact", "document", "text", files, "path").collect()}
    assert got == {(1, 7, "DESCRIBES", "src/app/main.py", 1), (1, 7, "DESCRIBES", "old/main.py", 1), (1, 7, "DESCRIBES", "/top.txt", 1), (1, 7, "MENTIONS", "src", 1), (1, 7, "MENTIONS", "app", 1), (2, 8, "DESCRIBES", "src/x.c", 2)}


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(6)
    some = ["".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    return some + ["", "a", "ab", "abc", "%_", "a%b", "aaaaaaa", "😀", "x😀y😀", "A"], [*some[60:], "zzz", "abcabcabc", "q%_q", "x😀y😀z", "ba" * 500]


def test_containment_by_a_plain_loop(spark, strings):
    needles, hay = (spark.createDataFrame([(s,) for s in [*x, None, x[0]]], f"{c} string") for x, c in zip(strings, "nh"))
    found = substrings.contained(needles, "n", hay, "h")
    assert sorted(map(tuple, found.collect())) == sorted({(n, h) for n in strings[0] for h in strings[1] if n in h})
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    both = substrings.either_way(needles, "n", hay, "h").collect()
    assert sorted(map(tuple, both)) == sorted({(n, h) for n in strings[0] for h in strings[1] if n in h or h in n})


def test_nothing_contained(spark):
    none = spark.createDataFrame([], "w string")
    some = spark.createDataFrame([("abc",)], "w string")
    assert substrings.contained(none, "w", some, "w").count() == 0 and substrings.contained(some, "w", none, "w").count() == 0
