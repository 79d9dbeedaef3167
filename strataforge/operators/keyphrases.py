"""Key phrases of texts: n-grams near the text in meaning, chosen one after another by maximal marginal relevance.

Words meet their vectors by a join of the distinct words of some whole texts at a time (``encoder.met``), so memory is
bounded by such a piece, not by the corpus or the vocabulary; n-grams are numbers until they are chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoder import Piece, met, opened

#: n-grams whose vectors are made at a time.
SLICE = 1 << 16


def candidates(codes: np.ndarray, words: int, least: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(n, first places of the distinct n-grams in order) for each n; ``codes`` are numbers below ``words``."""
    out, gram = [], codes
    for n in range(1, most + 1):
        if n > 1:
            gram = gram[:-1] * words + codes[n - 1 :]
        if len(gram):
            _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
            if n >= least:
                out.append((n, np.sort(first)))
    return out


def chosen(relevance: np.ndarray, vectors: np.ndarray, top: int, diversity: float) -> list[tuple[int, float]]:
    """(place, score) of ``top`` rows: each next has the greatest (1 - diversity) * relevance - diversity * nearness to one chosen before.

    The first is the most relevant; equal scores (to 9 digits) go to the earlier row.
    """
    out: list[tuple[int, float]] = []
    score, left = relevance.copy(), (1 - diversity) * relevance
    nearest = np.full(len(vectors), -np.inf)
    while len(out) < min(top, len(vectors)):
        close = np.flatnonzero(score >= score.max() - 2e-9)
        best = int(close[np.argmax(np.round(score[close], 9))] if len(close) > 1 else close[0])
        out.append((best, float(score[best])))
        left[best] = -np.inf
        np.maximum(nearest, vectors @ vectors[best], out=nearest)
        np.subtract(left, np.multiply(nearest, diversity, out=score), out=score)
    return out


def _ranked(piece: Piece, lengths: tuple[int, int], top: int, diversity: float):
    """(place in the piece's keys, rank, phrase, relevance, score) of each of its texts' key phrases."""
    for k, codes in piece.texts():
        if not piece.known[codes].any():
            continue
        whole = piece.summed(codes)
        if not whole.any():
            continue
        grams = [(n, at[piece.known[codes[at[:, None] + np.arange(n)]].any(axis=1)]) for n, at in candidates(codes, len(piece.words), *lengths)]
        ends = np.cumsum([0, *(len(at) for _, at in grams)])
        if not ends[-1]:
            continue
        vectors = np.empty((ends[-1], piece.vectors.shape[1]), np.float32)
        for (n, at), start in zip(grams, ends, strict=False):
            for i in range(0, len(at), SLICE):
                v = sum(piece.vectors[codes[at[i : i + SLICE] + j]] for j in range(n))
                vectors[start + i : start + i + len(v)] = v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-300)
        relevance = (vectors @ (whole / np.linalg.norm(whole)).astype(np.float32)).astype(np.float64)
        for rank, (j, score) in enumerate(chosen(relevance, vectors, top, diversity), 1):
            which = int(np.searchsorted(ends, j, side="right")) - 1
            n, at = grams[which]
            at = at[j - ends[which]]
            yield k, rank, " ".join(piece.words[c] for c in codes[at : at + n]), float(relevance[j]), score


def phrases(docs: DataFrame, key: str, text: str, words: DataFrame, lengths: tuple[int, int] = (1, 2), top: int = 20, diversity: float = 0.5) -> DataFrame:
    """(key, rank, phrase, relevance, score): up to ``top`` key phrases of ``lengths`` words for each row of ``docs``.

    ``words`` has (word, vector, weight).  A phrase's vector is the sum of its words', the text's the weighted sum of all its
    words'; relevance is their cosine.  Phrases without a known word are none.  Null and empty texts
    have no phrases; each of the rows that repeat a key has its own.  ``diversity`` 0 ranks by relevance alone.
    """
    kind = docs.schema[key].dataType.simpleString()

    def rank(group: pa.Table) -> pa.Table:
        piece = opened(group)
        out = list(_ranked(piece, lengths, top, diversity))
        places, *columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64()]
        return pa.table([piece.keys.take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", "rank", "phrase", "relevance", "score"])

    return met(docs, key, text, words).groupBy("piece").applyInArrow(rank, f"key {kind}, rank int, phrase string, relevance double, score double").withColumnRenamed("key", key)
