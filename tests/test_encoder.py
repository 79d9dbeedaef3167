"""Encoder against a dense factorisation, key phrases against a plain loop."""

import collections
import math
import random
import re

import numpy as np
import pytest

from strataforge.functions.text import STOPWORDS
from strataforge.operators import encoder, keyphrases


def words_of(text):
    found = re.split(r"\s+", re.sub(r"[^\w\s]|_", " ", (text or "").lower()))
    return [w for w in found if len(w) >= 3 and w not in STOPWORDS and not w.isdigit()]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    topics = [[f"{t}{k}word" for k in range(25)] for t in ("data", "graph", "text", "code")]
    made = []
    for i in range(50):
        own = topics[i % 4]
        made.append((i, " ".join(rng.choice(own if rng.random() < 0.8 else rng.choice(topics)) + rng.choice(["", ",", ".", " the", " 12"]) for _ in range(60))))
    return made + [(50, None), (51, ""), (52, "nothing known here")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def dense(rows, window, least):
    lists = [words_of(t) for _, t in rows]
    counts = collections.Counter(w for x in lists for w in x)
    names = sorted(w for w, n in counts.items() if n >= least)
    at = {w: i for i, w in enumerate(names)}
    n = np.zeros((len(names), len(names)))
    for x in lists:
        for i, a in enumerate(x):
            for b in x[i + 1 : i + 1 + window]:
                if a in at and b in at:
                    n[at[a], at[b]] += 1
                    n[at[b], at[a]] += 1
    with np.errstate(divide="ignore"):
        m = np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0)))
    return names, n, np.where(m > 0, m, 0)


def test_associations_are_the_dense_ones(docs, rows, monkeypatch):
    monkeypatch.setattr(encoder, "CHUNK", 7)  # texts are paired piece by piece
    names, n, m = dense(rows, 4, 5)
    got = {(r["word"], r["context"]): (r["n"], r["ppmi"]) for r in encoder.associations(encoder.cooccurrences(docs, "text")).collect()}
    want = {(names[i], names[j]): (n[i, j], m[i, j]) for i, j in zip(*np.nonzero(m))}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9) for k in want)


@pytest.fixture(scope="module")
def words(docs):
    return encoder.fit(docs, "text", dimensions=8).cache()


def test_factors_are_the_dense_ones(words, rows):
    names, _, m = dense(rows, 4, 5)
    got = {r["word"]: r["vector"] for r in words.collect()}
    assert sorted(got) == names
    x = np.array([got[w] for w in names])
    singular = np.linalg.svd(m, compute_uv=False)[:8]
    found = (x**2).sum(0)
    assert np.allclose(found[:4], singular[:4], rtol=0.001)  # the topics
    assert (found <= singular * 1.000001).all() and (found >= singular * 0.75).all()  # beyond, the spectrum is flat, and a range finder stays below it
    values, vectors = np.linalg.eigh(m)
    first = np.argsort(-np.abs(values))[:3]
    for k, j in enumerate(first):  # the leading directions
        assert abs(x[:, k] @ vectors[:, j]) / np.linalg.norm(x[:, k]) > 0.99


def test_pairs_meet_in_tiles_and_take_less_room(docs, rows, monkeypatch):
    for name, size in {"BLOCK": 16, "CHUNK": 100, "COUNTED": 500, "GROUP": 64, "TILE": 64}.items():
        monkeypatch.setattr(encoder, name, size)  # seven blocks, many pieces, groups and parts
    names, n, m = dense(rows, 4, 5)
    counts = encoder.counted(docs, "text")
    ids = {r["id"]: (r["word"], r["own"]) for r in counts.words.collect()}
    got = [(ids[a][0], ids[b][0], k) for r in counts.pairs.collect() for a, b, k in zip(r["a"], r["b"], r["n"], strict=True)]
    at = {w: i for i, w in enumerate(names)}
    assert counts.blocks == 7 and counts.total == n.sum() and all(own == n[at[w]].sum() for w, own in ids.values())
    assert len(got) == len({frozenset(p[:2]) for p in got}) == np.count_nonzero(np.triu(n))  # a row for both directions
    assert all(k * (1 + (x == y)) == n[at[x], at[y]] for x, y, k in got)
    found = encoder.fit(docs, "text", dimensions=8)
    x = {r["word"]: r["vector"] for r in found.collect()}
    assert sorted(x) == names
    assert np.allclose((np.array([x[w] for w in names]) ** 2).sum(0)[:4], np.linalg.svd(m, compute_uv=False)[:4], rtol=0.001)


def test_texts_of_a_topic_are_near(docs, words):
    got = {r["doc_id"]: r for r in encoder.encode(docs, "doc_id", "text", words, 8).collect()}
    assert len(got) == 53 and all(got[i]["vector"] is None and got[i]["n_words"] == 0 for i in (50, 51, 52))
    x = np.array([got[i]["vector"] for i in range(50)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    near = x @ x.T - 2 * np.eye(50)
    assert np.mean([near[i].argmax() % 4 == i % 4 for i in range(50)]) > 0.9


@pytest.mark.parametrize("diversity", [0.0, 0.5])
def test_key_phrases_by_a_plain_loop(docs, rows, words, diversity):
    known = {r["word"]: (np.array(r["vector"]), r["weight"]) for r in words.collect()}
    got = {}
    for r in keyphrases.phrases(docs, "doc_id", "text", words, (1, 3), 6, diversity).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = (r["phrase"], r["score"])
    assert set(got) == set(range(50))
    unit = lambda v: v / np.linalg.norm(v)
    for i, text in rows[:12]:
        mine = words_of(text)
        whole = unit(sum(known[w][0] * known[w][1] for w in mine if w in known))
        options = {}
        for n in (1, 2, 3):
            for j in range(len(mine) - n + 1):
                gram = mine[j : j + n]
                if any(w in known for w in gram):
                    options.setdefault(" ".join(gram), unit(sum(known[w][0] for w in gram if w in known)))
        taken = []
        for place in range(1, 7):
            score = {p: v @ whole if not taken else (1 - diversity) * (v @ whole) - diversity * max(v @ options[t] for t in taken) for p, v in options.items() if p not in taken}
            phrase, said = got[i][place]
            assert abs(said - max(score.values())) < 1e-5 and abs(score[phrase] - max(score.values())) < 1e-5
            taken.append(phrase)


def test_no_texts(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    words = encoder.fit(none, "text", dimensions=4)
    assert words.count() == 0 and keyphrases.phrases(none, "doc_id", "text", words).count() == 0
    assert encoder.encode(none, "doc_id", "text", words, 4).first()["vector"] is None


def test_a_word_and_its_vector_are_sent_once_a_piece(docs, words, monkeypatch):
    rows = encoder.met(docs, "doc_id", "text", words).groupBy("piece").agg({"*": "count", "word": "count"}).collect()
    known = words.count()
    assert rows and all(r["count(word)"] <= known + 4 for r in rows)  # of 50 texts in 3 partitions; once a text it would be over 1,000
    whole = {tuple(r)[:3] for r in keyphrases.phrases(docs, "doc_id", "text", words, (1, 2), 6).collect()}
    vectors = {r["doc_id"]: r["vector"] for r in encoder.encode(docs, "doc_id", "text", words, 8).collect()}
    monkeypatch.setattr(encoder, "PIECE", 100)  # pieces of two texts
    assert encoder.met(docs, "doc_id", "text", words).select("piece").distinct().count() > len(rows)
    assert {tuple(r)[:3] for r in keyphrases.phrases(docs, "doc_id", "text", words, (1, 2), 6).collect()} == whole
    again = {r["doc_id"]: r["vector"] for r in encoder.encode(docs, "doc_id", "text", words, 8).collect()}
    assert again.keys() == vectors.keys() and all((v is None) == (again[k] is None) and (v is None or np.allclose(v, again[k])) for k, v in vectors.items())


def test_equal_scores_go_to_the_earlier_phrase():
    vectors = np.array([[1, 0], [0, 1], [1, 0], [0.6, 0.8]], np.float32)
    assert [k for k, _ in keyphrases.chosen(np.array([0.5, 0.5 + 4e-10, 0.5, 0.1]), vectors, 9, 0.5)] == [0, 1, 2, 3]
    assert [k for k, _ in keyphrases.chosen(np.array([0.5, 0.5, 0.7, 0.1]), vectors, 3, 0.0)] == [2, 0, 1]


@pytest.mark.parametrize("dense", [0, 0.05, 1])
def test_products_of_dense_and_thin_cells(dense, monkeypatch):
    for name, value in {"CELL": 16, "DENSE": dense}.items():
        monkeypatch.setattr(encoder, name, value)
    rng = np.random.default_rng(1)
    m = np.where(rng.random((50, 37)) < np.linspace(0.4, 0, 50)[:, None], rng.random((50, 37)), 0).astype(np.float32)
    a, b = (c.astype(np.int32) for c in np.nonzero(m))
    xa, xb, ya, yb = rng.random((50, 5), np.float32), rng.random((37, 5), np.float32), np.ones((50, 5)), np.zeros((37, 5))
    encoder._spread(a, b, m[a, b], xa, xb, ya, yb)
    assert np.allclose(ya, 1 + m @ xb, rtol=1e-5) and np.allclose(yb, m.T @ xa, rtol=1e-5)
    u = np.triu(m[:37])  # both sides the same block
    a, b = (c.astype(np.int32) for c in np.nonzero(u))
    y = np.zeros((37, 5))
    encoder._spread(a, b, u[a, b], xb, xb, y, y)
    assert np.allclose(y, u @ xb + u.T @ xb, rtol=1e-5)
