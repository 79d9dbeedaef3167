"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a hashed word embedding and the mean of its hashed character
trigram embeddings (lower-cased, stripped of ASCII punctuation at its ends for the
word).  A text is scored over all overlapping windows of ``WINDOW`` words, one every
``STRIDE`` words, whatever its length; its score is that of its worst window,
calibrated by logistic regression on labelled texts kept out of the training.

Labels name texts, not windows, so training alternates: score all windows of a
text, take the highest one or two of a toxic text as toxic, and of a clean one
the highest and some others as clean, then descend.  The first order comes from
smoothed log-odds of words and trigrams, which also start the embeddings.

Training uses at most ``MOST_LABELLED`` labelled texts of each class, those first
in hash order of their id, on the driver.  Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import ASCII_LOWER, SEPARATORS, U64, Words, mix, ragged, text_slices
from .workspace import share

#: Labelled texts of each class that training may use.
MOST_LABELLED = 1500
#: Length of a text that training uses; scoring takes texts of any length whole.
MOST_CHARS = 1 << 15
WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 16, 14
WIDTH, HIDDEN, GAZE = 6, 8, 8  # of an embedding, of a direction's state, of attention
ROUNDS, EPOCHS, LEAST_STEPS, BATCH, RATE = 3, 2, 80, 256, 0.01
CLEAN_WINDOWS = 6
THRESHOLD = 0.3
SEED = 20
_F = np.float32


@dataclass
class Inputs:
    """Words of some texts as embedding rows: word numbers, and trigram numbers with each word's first."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    bounds: np.ndarray


def inputs(data: np.ndarray, offsets: np.ndarray) -> Inputs:
    words = Words(data, offsets, ASCII_LOWER)
    bare = words.bare()
    low = words.data
    hashes = np.zeros(len(words), U64)
    at = np.searchsorted(words.start, bare.start, "right") - 1
    hashes[at] = bare.hashes()
    sides = np.where(SEPARATORS[data], 0, low).astype(np.uint32)
    padded = np.concatenate([np.zeros(1, np.uint32), sides, np.zeros(1, np.uint32)])
    gram = padded[:-2] * np.uint32(0x9E3779B1) + padded[1:-1] * np.uint32(0x85EBCA77) + padded[2:] * np.uint32(0xC2B2AE3D)
    gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    lengths = words.end - words.start
    inside = ~SEPARATORS[data]
    return Inputs((hashes >> U64(64 - WORD_BITS)).astype(np.int32), (gram[inside] >> np.uint32(32 - GRAM_BITS)).astype(np.int32), np.cumsum(lengths) - lengths, words.bounds)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; a text without words has one empty window."""
    count = np.diff(bounds)
    number = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
    text, k = ragged(number)
    begin = bounds[text] + k * STRIDE
    return text, begin, np.minimum(bounds[text + 1] - begin, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


class Network:
    """Embeddings, two gated recurrences, attention over their states, one output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def small(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(_F)

        wide = 2 * WIDTH
        self.p = {"word": small(1 << WORD_BITS, WIDTH, scale=0.02), "gram": small(1 << GRAM_BITS, WIDTH, scale=0.02)}
        for way in "fb":
            self.p |= {f"x{way}": small(wide, 3 * HIDDEN, scale=wide**-0.5), f"c{way}": np.zeros(3 * HIDDEN, _F), f"u{way}": small(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
        self.p |= {"look": small(2 * HIDDEN, GAZE, scale=0.3), "gaze": small(GAZE, scale=0.3), "out": small(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, _F)}
        self.slope, self.shift = 1.0, 0.0

    def embed(self, x: Inputs) -> np.ndarray:
        n = len(x.word)
        out = np.zeros((n, 2 * WIDTH), _F)
        if n:
            out[:, :WIDTH] = self.p["word"][x.word]
            size = np.diff(np.append(x.first, len(x.gram))).astype(_F)
            out[:, WIDTH:] = np.add.reduceat(self.p["gram"][x.gram], x.first, axis=0) / size[:, None]
        return out

    def forward(self, vectors: np.ndarray, begin: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the backward pass needs."""
        p, b = self.p, len(begin)
        steps = int(size.max(initial=0))
        if steps == 0:
            return (np.full(b, p["bias"][0], _F), None) if keep else np.full(b, p["bias"][0], _F)
        place = np.minimum(begin[None, :] + np.arange(steps)[:, None], max(len(vectors) - 1, 0))
        mask = (np.arange(steps)[:, None] < size[None, :]).astype(_F)[:, :, None]
        states = np.zeros((steps, b, 2 * HIDDEN), _F)
        tape: dict[str, list] = {"f": [], "b": []}
        for way, order, at in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
            pre = vectors @ p[f"x{way}"] + p[f"c{way}"]
            u = p[f"u{way}"]
            h = np.zeros((b, HIDDEN), _F)
            for t in order:
                g, hu = pre[place[t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = hu[:, 2 * HIDDEN :]
                n = np.tanh(g[:, 2 * HIDDEN :] + r * c)
                if keep:
                    tape[way].append((t, h, z, r, c, n))
                h = h + mask[t] * (1 - z) * (n - h)
                states[t, :, at] = h
        seen = np.tanh(states @ p["look"])
        weight = seen @ p["gaze"] + (mask[:, :, 0] - 1) * _F(1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        weight *= mask[:, :, 0]
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (place, mask, states, tape, seen, weight, pooled)) if keep else logit

    def backward(self, vectors: np.ndarray, slope: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients from that of the logits; the second is that of the word vectors."""
        p = self.p
        place, mask, states, tape, seen, weight, pooled = kept
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        grad["out"], grad["bias"][0] = pooled.T @ slope, slope.sum()
        d_pool = slope[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pool[None]
        d_weight = np.einsum("bh,tbh->tb", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        d_seen = d_score[:, :, None] * p["gaze"] * (1 - seen**2)
        grad["gaze"] = np.einsum("tb,tbg->g", d_score, seen)
        grad["look"] = np.einsum("tbh,tbg->hg", states, d_seen)
        d_states += d_seen @ p["look"].T
        d_vectors = np.zeros_like(vectors)
        for way, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, x = p[f"u{way}"], p[f"x{way}"]
            dh = np.zeros_like(states[0, :, at])
            for t, h, z, r, c, n in reversed(tape[way]):
                dh = dh + d_states[t, :, at]
                moved = mask[t] * dh
                d_n = moved * (1 - z) * (1 - n**2)
                d_z = moved * (h - n) * z * (1 - z)
                d_r = d_n * c * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_n * r], 1)
                d_g = np.concatenate([d_z, d_r, d_n], 1)
                grad[f"u{way}"] += h.T @ d_u
                dh = dh * (1 - mask[t]) + moved * z + d_u @ u.T
                grad[f"c{way}"] += d_g.sum(0)
                grad[f"x{way}"] += vectors[place[t]].T @ d_g
                np.add.at(d_vectors, place[t], d_g @ x.T)
        return grad, d_vectors

    def _fast(self, vectors: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``forward`` without a tape, in place; ``vectors`` is not empty."""
        p, b, steps = self.p, len(begin), int(size.max())
        full = int(size.min())
        states = np.empty((2, steps, b, HIDDEN), _F)
        half = np.full((b, 2 * HIDDEN), 0.5, _F)
        gates, fresh, back = (np.empty((b, k * HIDDEN), _F) for k in (2, 1, 1))
        top = len(vectors) - 1
        for way, out, order in (("f", states[0], range(steps)), ("b", states[1], range(steps - 1, -1, -1))):
            x, c, u = p[f"x{way}"], p[f"c{way}"], p[f"u{way}"]
            pre_gates = (vectors @ x[:, : 2 * HIDDEN] + c[: 2 * HIDDEN]) * _F(0.5)
            pre_fresh = vectors @ x[:, 2 * HIDDEN :] + c[2 * HIDDEN :]
            u_gates, u_fresh = np.ascontiguousarray(u[:, : 2 * HIDDEN]) * _F(0.5), np.ascontiguousarray(u[:, 2 * HIDDEN :])
            h = np.zeros((b, HIDDEN), _F)
            for t in order:
                at = np.minimum(begin + t, top) if t >= full else begin + t
                np.matmul(h, u_gates, out=gates)
                gates += pre_gates.take(at, 0)
                np.tanh(gates, out=gates)
                gates *= half
                gates += half
                np.matmul(h, u_fresh, out=fresh)
                fresh *= gates[:, HIDDEN:]
                fresh += pre_fresh.take(at, 0)
                np.tanh(fresh, out=fresh)
                fresh -= h
                np.subtract(_F(1), gates[:, :HIDDEN], out=back)
                fresh *= back
                if t >= full:
                    fresh *= (size > t)[:, None]
                h = np.add(h, fresh, out=out[t])
        look = p["look"]
        weight = np.tanh(states[0] @ look[:HIDDEN] + states[1] @ look[HIDDEN:]) @ p["gaze"]
        if full < steps:
            weight[np.arange(steps)[:, None] >= size] = -1e9
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        value = states[0] @ p["out"][:HIDDEN] + states[1] @ p["out"][HIDDEN:]
        return np.where(size > 0, (weight * value).sum(0), 0) + p["bias"][0]

    def logits(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        text, begin, size = windows(x.bounds)
        vectors = self.embed(x)
        out = np.empty(len(text), _F)
        order = np.argsort(-size, kind="stable")  # full windows first: few batches need a mask
        for i in range(0, len(text), 1024):
            some = order[i : i + 1024]
            out[some] = self._fast(vectors, begin[some], size[some]) if len(vectors) and size[some].max() else self.p["bias"][0]
        return text, out

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest window logit of each text."""
        text, logit = self.logits(inputs(data, offsets))
        return np.maximum.reduceat(logit, np.flatnonzero(np.append(True, text[1:] != text[:-1]))) if len(text) else logit

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst.astype(float) + self.shift, -40, 40)))


def _log_odds(numbers: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of a text being toxic, over its rate, given that it holds each number."""
    held = np.zeros((2, size))
    for i, kind in enumerate(toxic):
        held[kind, np.unique(numbers[bounds[i] : bounds[i + 1]])] += 1
    clean, all_toxic = max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())
    floor = 2.0 / max(2, min(clean, all_toxic))
    return np.clip(np.log((held[1] / all_toxic + floor) / (held[0] / clean + floor)), -4, 4)


def _calibrated(worst: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one feature, lightly ridged (Newton steps)."""
    center, spread = worst.mean(), worst.std() + 1e-6
    x = np.stack([(worst - center) / spread, np.ones_like(worst)], 1).astype(float)
    w = np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (q * (1 - q))[:, None]) + np.diag([0.05, 1e-3])
        w -= np.linalg.solve(h, x.T @ (q - toxic) + np.array([0.05, 1e-3]) * w)
    return max(w[0], 1e-3) / spread, w[1] - max(w[0], 1e-3) * center / spread


def train(texts: list[str | None], toxic: np.ndarray, kept_out: np.ndarray, toxic_rate: float) -> Network:
    """A network from labelled texts; those kept out calibrate it.  One class alone gives a constant score.

    ``toxic_rate`` is the share of toxic texts among all labelled ones.  The sample has
    the classes in other proportions, which the calibration weighs back.
    """
    net = Network()
    toxic = np.asarray(toxic, np.int64)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        net.p["out"][:] = 0
        net.slope, net.shift = 1.0, -6.0 if len(toxic) == 0 or toxic[0] == 0 else 6.0
        return net
    rng = np.random.default_rng(SEED)

    def prepare(chosen: np.ndarray) -> tuple[Inputs, list[Inputs]]:
        """The texts' inputs end to end, and the same by slices, which bound what one pass over them needs."""
        whole = pa.array([texts[i] for i in chosen], pa.large_string())
        parts = [inputs(data, offsets) for _, _, data, offsets in text_slices(whole)]
        words, grams = (np.cumsum([0] + [len(getattr(x, k)) for x in parts]) for k in ("word", "gram"))
        joined = Inputs(
            np.concatenate([x.word for x in parts]),
            np.concatenate([x.gram for x in parts]),
            np.concatenate([x.first + g for x, g in zip(parts, grams, strict=False)]),
            np.concatenate([[0], *(x.bounds[1:] + w for x, w in zip(parts, words, strict=False))]),
        )
        return joined, parts

    fit = np.flatnonzero(~kept_out)
    if toxic[fit].min(initial=1) == toxic[fit].max(initial=0) or not kept_out.any():
        fit = np.arange(len(toxic))
    (x, parts), y = prepare(fit), toxic[fit]
    wide = np.diff(np.append(x.first, len(x.gram)))
    net.p["word"][:, 0] = odds = _log_odds(x.word, x.bounds, y, 1 << WORD_BITS) / 2
    net.p["gram"][:, 0] = _log_odds(x.gram, np.append(x.first, len(x.gram))[x.bounds], y, 1 << GRAM_BITS) / 2
    text, begin, size = windows(x.bounds)
    prior = np.concatenate([odds[x.word], [0.0]])
    score = np.maximum.reduceat(prior, np.minimum(np.stack([begin, begin + size], 1).ravel(), len(prior) - 1))[::2] if len(text) else np.zeros(0)
    score = np.where(size > 0, score, -9.0)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items() if k not in ("word", "gram")}
    square = {k: np.full(len(net.p[k]), 1e-3, _F) for k in ("word", "gram")}
    step = 0
    for turn in range(ROUNDS):
        if turn:
            score = np.concatenate([net.logits(part)[1] for part in parts])
        order = np.lexsort((-score, text))
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        clean = y[text[order]] == 0
        chosen = order[np.where(clean, rank < CLEAN_WINDOWS // 2, (rank < 1) | ((rank < 2) & (score[order] > 0)))]
        others = np.flatnonzero(y[text] == 0)
        more = rng.choice(others, min(len(others), CLEAN_WINDOWS // 2 * int((y == 0).sum())), replace=False)
        chosen = np.unique(np.concatenate([chosen, more]))
        label = y[text[chosen]].astype(_F)
        heavy = np.where(label == 1, 0.5 * len(label) / max(1, label.sum()), 0.5 * len(label) / max(1, (1 - label).sum())) ** 0.5
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))):
            shuffled = rng.permutation(len(chosen))
            for i in range(0, len(shuffled), BATCH):
                step += 1
                some = shuffled[i : i + BATCH]
                at = chosen[some]
                own, k = ragged(size[at])
                word = begin[at][own] + k
                small = Inputs(x.word[word], x.gram, x.first, x.bounds)
                long = wide[word]
                mine, j = ragged(long)
                small.gram, small.first = x.gram[x.first[word][mine] + j], np.cumsum(long) - long
                vectors = net.embed(small)
                first = np.cumsum(size[at]) - size[at]
                logit, kept = net.forward(vectors, first, size[at], keep=True)
                if kept is None:
                    continue
                slope = ((1 / (1 + np.exp(-logit)) - label[some]) * heavy[some] / len(some)).astype(_F)
                grad, d_vectors = net.backward(vectors, slope, kept)
                for name, g in grad.items():
                    m, v = adam[name]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(_F)
                for name, number, g in (("word", small.word, d_vectors[:, :WIDTH]), ("gram", small.gram, (d_vectors[:, WIDTH:] / long[:, None])[mine])):
                    rows, back = np.unique(number, return_inverse=True)
                    total = np.zeros((len(rows), WIDTH), _F)
                    np.add.at(total, back, g.astype(_F))
                    square[name][rows] += (total**2).mean(1)
                    net.p[name][rows] -= _F(0.02) * total / np.sqrt(square[name][rows])[:, None]
    rest = np.flatnonzero(kept_out)
    if len(rest) and 0 < toxic[rest].sum() < len(rest):
        fit = rest
    whole = pa.array([texts[i] for i in fit], pa.large_string())
    worst = np.concatenate([net.worst(data, offsets) for _, _, data, offsets in text_slices(whole)])
    net.slope, net.shift = _calibrated(worst, toxic[fit])
    held = toxic[fit].mean()
    net.shift += np.log(toxic_rate / (1 - toxic_rate)) - np.log(held / (1 - held))
    return net


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on the labelled rows that are not held out: of each class at most ``MOST_LABELLED`` ids, a text each.

    Of contradicting labels of an id the toxic one holds; null labels and ids are dropped.
    Of rows that repeat an id the least text counts; texts of more than ``MOST_CHARS``
    take no part in training, so what comes to the driver has a fixed bound.
    """
    rows = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~is_held_out())
    share = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    rows = rows.withColumn("order", F.xxhash64("doc_id"))
    wanted = None
    for kind in (0, 1):
        some = rows.filter(F.col("toxic") == kind).orderBy("order", "doc_id").limit(MOST_LABELLED)
        wanted = some if wanted is None else wanted.union(some)
    wanted = F.broadcast(wanted)  # at most twice MOST_LABELLED rows
    short = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= MOST_CHARS)
    found = short.join(wanted, "doc_id").groupBy("order", "doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["order"], r["doc_id"]))
    toxic = np.array([r["toxic"] for r in found], np.int64)
    kept_out = mix(np.array([r["order"] for r in found], np.int64).view(U64)) % U64(4) == 0
    return train([r["text"] for r in found], toxic, kept_out, min(max(share or 0.0, 1e-3), 1 - 1e-3))


def _scores(net: Network, column: pa.Array) -> np.ndarray:
    parts = [net.worst(data, offsets) for _, _, data, offsets in text_slices(column)]
    return net.probability(np.concatenate(parts)) if parts else np.empty(0)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; predicted is 1 from ``THRESHOLD`` on.

    Null, empty and wordless texts get the score of an empty window.  Repeated rows
    are scored each, equal texts alike.  No label, or one class alone, gives a
    constant score.  Extra columns are ignored; no rows give none.
    """
    shared = share(docs.sparkSession, learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _scores(shared(), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; all columns kept."""
    shared = share(docs.sparkSession, learn(docs, labels))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared(), batch.column(text)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
