"""Corpus operators against brute force and on hard rows: nulls, empty and long texts, ties, repeats, empty tables."""

import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataforge.llm import annforest, components, decontamination, extraction, jaccard, mixing, sharding, substring, toxicity, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, node int"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    rng = random.Random(1)
    base = words(300, 7)
    texts = [None, "", "  \t\n ", "one", "one two three four", "One two three four", " ".join(words(5000, 3)), "same " * 200, "same " * 90]
    for k in range(8):  # edited copies of one text
        copy = list(base)
        for _ in range(k * 2):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts.append("\n".join(copy))
    passage = words(60, 11)
    texts += [" ".join(words(80, 100 + k) + passage + words(40, 200 + k)) for k in range(5)]
    texts += [" ".join(words(rng.randrange(1, 120), 300 + k)) for k in range(40)]
    texts += [texts[9], texts[9], texts[20]]  # equal texts
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), i, "x", 1) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[3], (None, "no id at all " * 9, None, None, None, None, None, None)]  # repeated rows, a null id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(docs, no_docs):
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in jaccard.similar_documents(docs).collect()) == want
    assert jaccard.similar_documents(no_docs).count() == 0
    kept = jaccard.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for i, r in enumerate(rows) if r[0] is not None and (not sets[i] or low[find(i)] == r[0])})


def test_one_row_of_each_component(spark):
    """Unrelated texts stay though their doc_id is null or one and the same; the row kept is one of its component."""
    alone = [" ".join(words(30, 900 + k)) for k in range(8)]
    near = " ".join(words(60, 950))
    rows = [(None, t) for t in alone[:3]] + [(None, alone[0])] + [(5, t) for t in alone[3:6]] + [(5, alone[3]), (7, alone[6]), (9, alone[7])]
    rows += [(9, near), (None, near + " end"), (8, near + " more words"), (None, None), (None, " ")]
    kept = Counter(tuple(r) for r in jaccard.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = {(None, t) for t in alone[:3]} | {(5, t) for t in alone[3:6]} | {(7, alone[6]), (9, alone[7]), (8, near + " more words"), (None, None), (None, " ")}
    assert kept == Counter(want)


def test_sketch_lower_bound():
    """Blocks that differ are no more than the shingles that do, and equal sets have equal keys."""
    a, b = np.sort(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)), None
    b = np.sort(np.concatenate([a[:280], np.random.default_rng(1).integers(0, 2**63, 10).astype(np.uint64)]))
    keys = [set(jaccard.sketch_keys(x, np.array([0, len(x)]))[1].tolist()) for x in (a, a, b)]
    assert keys[0] == keys[1]
    assert len(keys[0] - keys[2]) <= 2 * 30 * 2 and keys[0] & keys[2]


def test_leftovers_meet_in_blocks(spark, docs, monkeypatch):
    """Blocks of two members find the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    test_jaccard_components(docs, docs.limit(0))


def test_centres_of_unfitting_size(spark):
    """Texts that link with each other meet though the centres of all their blocks are too long for them."""
    passage = [f"common{k}" for k in range(23)]
    long = [(100 + k, " ".join(passage + [f"l{k}x{i}" for i in range(11)])) for k in range(300)]
    short = [(k, " ".join(passage + [f"s{k}x{i}" for i in range(3)])) for k in range(1, 9)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(long + short, "doc_id long, text string")).collect()}
    assert got == {k: k for k, _ in long} | {k: 1 for k, _ in short}


def test_open_members_of_the_main_component(spark):
    """One open in the main component (3) meets one outside it that is not open (2)."""
    texts = {1: words(40, 1), 2: words(40, 2), 3: words(40, 2) + ["end"], 4: words(40, 4), 5: words(40, 5)}
    tokens = {k: jaccard.shingle_sets(np.frombuffer(t := " ".join(v).encode(), np.uint8), np.array([0, len(t)])) for k, v in texts.items()}
    size, sig = {k: len(t[0]) for k, t in tokens.items()}, {k: bytearray(jaccard.signatures(*t)[0]) for k, t in tokens.items()}
    judged = spark.createDataFrame([(1, b, b == 3, size[1], size[b], sig[1], sig[b]) for b in (2, 3, 4, 5)], "a long, b long, open boolean, size_a long, size_b long, sig_a binary, sig_b binary")
    label = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)], "node long, component long")
    rest = jaccard._left_over(judged, label)
    assert rest is not None and {tuple(r) for r in rest.collect()} == {(2, 3)}


@pytest.mark.parametrize("size", [3, 40, 200, 256, 257, 300, 520, 900, 5000])
def test_signatures_pass_every_link(size):
    """Signatures never part sets at the threshold, whatever their levels, and mostly part unrelated ones."""
    rng = np.random.default_rng(size)
    passed = 0
    for _ in range(60):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        gone = size // 7
        b = np.concatenate([a[gone:], rng.integers(0, 2**63, gone, dtype=np.uint64)])
        both = size - gone
        if 100 * both < jaccard.PERCENT * (size + gone):
            b, both = a[gone:], size - gone
        c = np.concatenate([a[: size // 5], rng.integers(0, 2**63, size - size // 5, dtype=np.uint64)])
        rows = [np.sort(x) for x in (a, b, c)]
        sig = np.frombuffer(b"".join(jaccard.signatures(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))), np.uint64).reshape(3, 2, -1)
        assert jaccard.may_link(np.array([len(a)]), np.array([len(b)]), sig[:1], sig[1:2])[0]
        passed += int(jaccard.may_link(np.array([len(a)]), np.array([len(c)]), sig[:1], sig[2:])[0])
    assert passed <= 6 or size < 40


def test_substring_removal(docs, no_docs):
    rows = corpus()
    split = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring.removal_digest(docs).collect()) == want
    assert substring.remove_repeats(no_docs).count() == 0


def test_mixing_hits_targets(spark, docs, no_docs):
    table = {r["source"]: r for r in mixing.mixed_sizes(docs).collect()}
    total = sum(len(WORD.findall(r[1] or "")) for r in corpus())
    assert abs(sum(r["target"] for r in table.values()) - 1.5 * total) < 1e-6 * total
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in table.values())
    out = mixing.mixed_sizes(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in out) and len(out) == len(corpus())
    first, second = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert first == second and mixing.mix(docs).columns == docs.columns
    assert len(first) == sum(r["copies"] for r in out)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_sizes(no_docs).count() == 0


def greedy(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


@pytest.mark.parametrize("buckets", [4, 64, 1 << 14])
def test_minimax_shards(spark, docs, no_docs, buckets):
    base = docs.select((docs.n_chars * 0 + 16).alias("x"), sharding.text_key().alias("key"), "text")
    base = base.selectExpr("key", "cast(octet_length(coalesce(text, '')) + 16 as long) as size").cache()
    groups = sorted((r[0], r[1]) for r in base.groupBy("key").sum("size").collect())
    low, high = 1, sum(s for _, s in groups)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy([s for _, s in groups], mid) <= 6 else (mid + 1, high)
    ends = sharding.shard_ends(base, 6, buckets)
    loads = Counter()
    for k, s in groups:
        loads[sum(k > e for e in ends)] += s
    assert len(ends) <= 5 and max(loads.values()) == low


def test_shard_rows(docs, no_docs):
    out = sharding.shard(docs).collect()
    assert len(out) == len(corpus())
    for k in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    text = {r[0]: r[1] for r in corpus()}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 for r in out)
    homes = {}
    assert all(homes.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"] for r in out)
    assert sharding.shard(no_docs).count() == 0


def test_one_huge_group_leaves_no_shard_empty(spark):
    rows = [(i, "copy " * 50) for i in range(100)] + [(1000 + i, f"text {i} " * 9) for i in range(200)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).groupBy("shard").sum("size").collect()
    loads = sorted(r[1] for r in out)
    assert len(loads) == 5 and loads[-1] == 100 * 266 and loads[-2] < 0.5 * sum(loads[:-1])


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(5)
    items = [words(40, 900 + k, 5000) for k in range(6)]
    edited = [w if rng.random() > 0.15 else "changed" for w in items[2]]
    rows = [
        (1, " ".join(words(200, 1) + items[0] + words(50, 2))),
        (2, " ".join(words(10, 3) + edited)),
        (3, " ".join(w.upper() + "," for w in items[3])),
        (4, " ".join(words(400, 4))),
        (5, " ".join(items[4][:12])),
        (6, None),
        (7, ""),
        (1, " ".join(words(200, 1) + items[0] + words(50, 2))),
    ]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(90, None), (None, "x y z"), (91, "")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.leaks(found, bench).collect())
    assert got == Counter({(1, 0): 2, (2, 2): 1, (3, 3): 1})
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(found, bench).collect()) == [4, 5, 6, 7]
    assert decontamination.leaks(no_docs, bench).count() == 0
    assert decontamination.leaks(found, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(docs, bench).columns == docs.columns


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 17).astype(np.uint64)
        h = np.zeros((13, 18), int)
        for i in range(1, 13):
            for j in range(1, 18):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_toxicity_learns_and_takes_all_rows(spark, docs, no_docs):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        w = words(rng.randrange(5, 150), 5000 + i)
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vile", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, " "), (5, rows[5][1]), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    out = {(r["doc_id"]): r for r in toxicity.score(d, lab).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in held) for i in range(300))
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.9
    assert out[1000]["score"] == out[1001]["score"] == out[1002]["score"] and 0 <= out[1000]["score"] <= 1
    assert toxicity.score(d, lab).count() == len(rows)
    assert toxicity.score(no_docs, lab).count() == 0
    assert toxicity.score(d, lab.limit(0)).filter("score between 0 and 1").count() == len(rows)
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns


def test_gradients():
    """The backward pass agrees with differences of the forward pass."""
    net = toxicity.Network(3)
    rng = np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    vectors = rng.normal(size=(9, 2 * toxicity.WIDTH))
    begin, size = np.array([0, 4]), np.array([4, 5])
    _, kept = net.forward(vectors, begin, size, keep=True)
    grad, d_vectors = net.backward(vectors, np.ones(2), kept)
    for name in ("uf", "xb", "look", "gaze", "out", "cf"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = net.forward(vectors, begin, size).sum()
        net.p[name][at] = old - eps
        down = net.forward(vectors, begin, size).sum()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-2 * max(1, abs(grad[name][at]))


def test_url_rules(spark):
    urls = [
        "https://a.com/en/x", "http://www.example.com/en/7", "http://example.com/en/71?q#f", "https://EXAMPLE.net/de/8", "http://x.net/de/9", "http://notexample.com/en/7", "ftp://b.org/es/", "http://org/es/a",
        "no scheme.com/en/", None, "", "http://h.io", "http://h.io?x=/en/", "://a.com/en/", "http://a.com/en/://b/",
    ]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(0, urls[0], "h", 1)], "page_id long, url string, host string, n int")
    out = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()), key=lambda r: r[0])
    assert len(out) == len(urls) + 1
    by = {r[0]: r[1:] for r in out}
    assert by[0] == ("a.com", "/en/x", "com/en/", "block") and by[1][2:] == ("example.com/en/7", "allow") and by[2][1:] == ("/en/71", "example.com/en/7", "allow")
    assert by[3] == ("example.net", "/de/8", "example.net/de/8", "block") and by[4][2:] == ("net/de/", "allow") and by[5][2:] == ("com/en/", "block")
    assert by[6][2:] == ("org/es/", "block") and by[7][2:] == ("org/es/", "block")
    assert by[8][:3] == by[9][:3] == by[10][:3] == ("", "", None) and by[12][:2] == ("h.io", "") and by[13][:2] == ("a.com", "/en/") and by[14][:2] == ("a.com", "/en/://b/")
    assert all(r[4] in ("allow", "block") for r in out)
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_rules_say_what_the_contract_lists(spark):
    says = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = spark.createDataFrame([(i, f"http://w.{rule}1/a") for i, rule in enumerate(says)], "page_id long, url string")
    assert {r["rule"]: r["verdict"] for r in urlfilter.judge(pages).collect()} == says
    for rule, verdict in says.items():
        assert re.search(f"THEN '{rule}'.* END AS rule, .*starts_with\\(path, '{rule[rule.index('/'):]}'\\) THEN '{verdict}'.* END AS said", urlfilter.ORACLE_SQL)


def test_url_model_tells_classes_apart(spark):
    rng = random.Random(4)
    good = [f"http://h{rng.randrange(99)}.example.com/en/7{rng.randrange(999)}/paper-library-{rng.randrange(99)}" for _ in range(150)]
    bad = [f"http://h{rng.randrange(99)}.shop.com/en/cheap-pills-casino-{rng.randrange(99)}" for _ in range(150)]
    test = ["http://u.info/paper-library-5", "http://u.info/cheap-pills-casino-5"]
    pages = spark.createDataFrame(list(enumerate(good + bad + test)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages).collect()}
    assert got[300] == "allow" and got[301] == "block"


def test_url_model_keeps_rare_n_grams(spark):
    """An n-gram seen once counts however large the corpus is, and common and rare ones score alike."""
    urls = [("aaaaaaaa", True, 10**6), ("aaaaaaab", False, 10**6), ("xyzuvw", True, 1), ("qrstuv", False, 1)]
    model = urlfilter.language_models(spark.createDataFrame(urls, "body string, accepted boolean, n long"))
    rows = {r["gram"]: r for r in model.collect()}
    assert {"xyzuv", "yzuvw", "qrstu", "rstuv"} <= set(rows) and len(rows) == len({b[i:j] for b, _, _ in urls for i in range(8) for j in range(i + 1, min(i + 5, len(b)) + 1)})
    pages = spark.createDataFrame([(1, "u", "aaaaaaab"), (2, "v", "xyzuvw"), (3, "w", "qrstuv")], "page_id long, url string, body string")
    got = {r["page_id"]: r["v"] for r in urlfilter.scores(pages, model).groupBy("page_id").sum("value").toDF("page_id", "v").collect()}
    for page, _, body in pages.collect():
        assert abs(got[page] - sum(rows[body[max(0, i - 4) : i + 1]]["value"] for i in range(len(body)))) < 1e-9
    assert got[2] > 0 > got[3]


def test_forest_recall_and_hard_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # many equal vectors
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0] * 3), (None, [1.0] * 16), (3080, [None] * 16), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as level")
    got = {}
    for r in sorted(annforest.search(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    clean = spark.createDataFrame([r for r in rows[:1560] if r[0] is not None], "vec_id long, embedding array<float>")
    exact = annforest.nearest_exactly(clean)
    assert set(got) == set(exact)
    assert all(len(v) == 20 and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & set(exact[q])) / 20 for q in exact]) >= 0.9
    assert [i for i, _ in got[40]][:3] == exact[40][:3]
    assert annforest.search(df.limit(0)).count() == 0
    assert annforest.search(clean.limit(1)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200 + "\r\n\r\n é</p>"
    rows = [(1, "http://b.org/x", big), (9, "http://a.b.org/y?z", big), (4, None, big), (5, "http://b.org/x", "small"), (6, "http://b.org/x", "small"), (7, "u\r\nv", None), (8, "http://b.org/x", ""), (None, "http://c.d", big), (9, "http://a.b.org/y?z", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    out = warc.archived(pages).collect()
    assert [(r["urlkey"], r["captured"]) for r in out] == sorted((r["urlkey"], r["captured"]) for r in out)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want = Counter()
    for page, _, body in rows:
        data = (body or "").encode()
        again = len(data) >= 1000 and page != 9
        want[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None)] += 1
    assert got == want
    assert warc.archived(pages.limit(0)).count() == 0
    for r in out:  # the locator of every row leads to its record, a gzip member of its own
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            (offset, length, header, block), *more = warc.parse(f.read(r["length"]))
        assert (offset, length, more) == (0, r["length"], []) and header.get("X-Page") == (None if r["page_id"] is None else str(r["page_id"]))
        assert header["WARC-Type"] == "revisit" or hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r["payload_digest"]


def test_warc_long_pages_and_archives_by_bytes(spark, monkeypatch):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(200_000))
    pages = spark.createDataFrame([(1, "u", "x" * (17 << 20)), (2, "u", noise), (3, "u", noise), (4, "v", "y")], "page_id long, url string, html string").coalesce(1)
    out = {r["page_id"]: r for r in warc.archived(pages).collect()}
    assert out[1]["payload_bytes"] == 17 << 20 and (out[2]["record_type"], out[2]["refers_to"]) == ("revisit", 3) and len({r["file"] for r in out.values()}) == 1
    records = [r[0].encode() for r in warc.records(pages).collect()]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 10)
    made = [r.column(0)[0].as_py() + b"\0" for r in warc._archives(iter([pa.RecordBatch.from_pydict({"record": [x.decode() for x in records]})]))]
    assert len(made) > 1 and sum(len(list(warc.parse(a))) for a in made) == 4
    assert b"".join(gzip.decompress(a) for a in made) == b"".join(x + b"\r\n\r\n" for x in records)
    for damaged in (made[0][:-9], made[0][5:], made[-1] + b"garbage"):
        with pytest.raises(ValueError):
            list(warc.parse(damaged))


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((f"k{rng.randrange(9)}", "t", rng.randrange(99)) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert [r[:3] for r in warc.LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x in r)


def test_html_extraction(spark):
    page = (
        '<html><head><title>no</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>'
        "<article><h1>A &amp; B</h1><p>Short.<p>One <b>two</b>\n  three&nbsp;four<br>five</p><div class=comments><p>Nice article, I think, and long enough to look like text.</p></div></article>"
        "<aside><p>Some sidebar text that is long and has no links in it at all</p></aside><form><p>Subscribe</p></form><footer>&copy; x</footer>"
    )
    pages = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, ""), (1, "u", page), (4, "w", "<p>" * 50)], "page_id long, url string, html string").selectExpr("*", "'x' as text")
    out = sorted(map(tuple, extraction.extract(pages).collect()), key=str)
    text = "A & B\nShort.\nOne two three four five"
    assert out == sorted([(1, "u", text, len(text))] * 2 + [(2, "v", "", 0), (3, None, "", 0), (4, "w", "", 0)], key=str)
    assert extraction.extract(pages.limit(0)).count() == 0


LONG = "word " * 45
LAYOUT_CASES = [
    (f'<article><section class="related-work"><p>{LONG}</p></section></article>', LONG.strip()),
    (f'<div id="ad-hoc-networks"><h1>Ad hoc</h1><p>{LONG}<p>end of it</div>', f"Ad hoc\n{LONG.strip()}\nend of it"),
    (f"<article><h1>A title</h1><p>{LONG}</p><h2>Further reading</h2><ul><li><a href=x>One link</a><li><a href=y>Two links</a></ul><p>Thanks for reading.</p></article><footer>(c) x</footer>", f"A title\n{LONG.strip()}\nFurther reading\nOne link\nTwo links\nThanks for reading."),
    ("<h1>Title here</h1><p>Short one here.</p><p>Another short para.</p>", "Title here\nShort one here.\nAnother short para."),
    ('<p>first words here</p><svg width="1" /><p>second words here</p>', "first words here\nsecond words here"),
    ("<article><p>a <button>x</button> b</p><p><button>un<p>c d e f</article>", "a b\nun\nc d e f"),
    (f"<form id=aspnetForm><nav><a href=/>x</a></nav><main><h1>Hi</h1><p>{LONG}</p></main><p>Subscribe</p></form>", f"Hi\n{LONG.strip()}"),
    (f'<div class="post-comments"><p>{LONG}</p></div><div class="entry-content"><p>hello there</p></div>', "hello there"),
    (f'<div id=siteHeader><a href=/>Home</a></div><article><p>{LONG}</p><div class="comment-list"><p>{LONG}</p></div></article>', LONG.strip()),
    (f"<table><tr><td><ul><li><a>One</a><li><a>Two</a><li><a>Six</a></ul></td><td><p>{LONG}</p><p>{LONG}</p></td></tr></table>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f'<body class="page sidebar-left"><main><p>{LONG}</main><aside><p>{LONG}</aside>', LONG.strip()),
    (f'<div class="cookie-notice"><p>{LONG}</p></div><article><header><h1>T</h1></header><p>{LONG}</p></article>', f"T\n{LONG.strip()}"),
]


@pytest.mark.parametrize("case", range(len(LAYOUT_CASES)))
def test_html_layouts(case):
    page, text = LAYOUT_CASES[case]
    assert extraction.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<script ", "<!", "<svg>", "<button>", "<div>", "</div>", '<b a="<', "<!-- ", "text & "])
def test_html_in_linear_time(unit):
    began = time.time()
    extraction.blocks(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 10


def test_tree_agrees_with_its_pages():
    table = extraction.labelled()
    assert (extraction.grown().predict(table[:, :-1]) == table[:, -1]).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3), (101, 100)], "a long, b long")
    got = {r[0]: r[1] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "decontamination", "source_mix", "minimax_shards"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    shards = corpus_pipeline.run(spark, sf)
    assert shards.count() > 0
