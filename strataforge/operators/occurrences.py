"""Occurrences of many given words in texts and in key phrases, by Arrow: what texts repeat is searched once a batch.

A word without a blank stands within a run of characters other than white space, and such runs repeat; words with one
are searched in whole texts.  Given words are lower-case ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Any character but ASCII, Latin letters and common marks: it may be part of a word to Java and none to Python, or the other way round.
_DOUBTFUL = re.compile(r"[^\x00-\x7f -©«¬®-±´¶-¸»¿-ɏ‐-‧‰-‾€]")

Words = dict[str, tuple[str, ...]]


def _summed(row: np.ndarray, which: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums by ``row`` of the lines ``which`` of ``values``."""
    fine = np.flatnonzero(values.any(axis=1)[which]) if len(values) else np.zeros(0, np.int64)
    row, which = row[fine], which[fine]
    return np.stack([np.bincount(row, values[which, k], rows).astype(np.int64) for k in range(values.shape[1])], axis=1)


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place in the third) of each string of lists, and the distinct strings; nulls are none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    row, valid = np.repeat(np.arange(len(lists)), sizes), flat.is_valid().to_numpy(zero_copy_only=False)
    coded = flat.drop_null().dictionary_encode()
    return row[valid], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def in_texts(texts: pa.Array, groups: Words, whole: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrences anywhere by group, standing alone by group of ``whole``, doubtful) of each text.

    ``whole`` has no word with a blank.  Doubtful texts hold a word beside a character that this does not judge.
    """
    row, which, runs = _coded(pc.ascii_split_whitespace(texts))
    wide = np.zeros((len(texts), len(groups)), np.int64)
    found = np.zeros((len(runs), len(groups) + len(whole) + 1), np.int64)
    for k, words in enumerate(groups.values()):
        for w in words:
            to, at = (wide, texts) if " " in w else (found, runs)
            to[:, k] += pc.count_substring(at, w).to_numpy(zero_copy_only=False)
    for k, (name, words) in enumerate(whole.items(), len(groups)):
        alone, some = re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)"), np.flatnonzero(found[:, list(groups).index(name)])
        for i, run in zip(some, runs.take(pa.array(some)).to_pylist(), strict=True):
            found[i, k] = len(alone.findall(run))
            found[i, -1] |= bool(_DOUBTFUL.search(run))
    out = _summed(row, which, found, len(texts))
    n = len(groups)
    return out[:, :n] + wide, out[:, n:-1], out[:, -1] > 0


def in_keys(keys: pa.Array, groups: Words) -> np.ndarray:
    """Per list of keys and group, how many pairs (key, word) there are of which one holds the other; null keys hold nothing."""
    row, which, distinct = _coded(keys)
    found = np.zeros((len(distinct), len(groups)), np.int64)
    within: dict[str, np.ndarray] = {}
    for k, words in enumerate(groups.values()):
        for w in words:
            found[:, k] += pc.match_substring(distinct, w).to_numpy(zero_copy_only=False)
            for part in {w[i:j] for i in range(len(w) + 1) for j in range(i, len(w) + 1)} - {w}:  # the word itself is counted above
                within.setdefault(part, np.zeros(len(groups), np.int64))[k] += 1
    for i, key in enumerate(distinct.to_pylist()):
        if key in within:
            found[i] += within[key]
    return _summed(row, which, found, len(keys))


def scores(low: str, keys: str, domains: Words, dimensions: Words, styles: Words) -> Column:
    """Struct of structs: domains (occurrences, and 2 a pair of key and word), dimensions (occurrences), whole (those that stand alone), styles, and doubtful.

    Of doubtful texts ``whole`` may be wrong.  ``low`` and ``keys`` are in lower case and not null.
    """
    kinds = {"domains": domains, "dimensions": dimensions, "whole": dimensions, "styles": styles}
    schema = ", ".join(f"{kind}: struct<{', '.join(f'{name}: bigint' for name in names)}>" for kind, names in kinds.items())

    def score(texts: pa.Array, phrases: pa.Array) -> pa.Array:
        groups = {(k, name): words for k, part in enumerate((domains, dimensions, styles)) for name, words in part.items()}
        anywhere, whole, doubtful = in_texts(texts, groups, {(1, name): words for name, words in dimensions.items()})
        d, e = len(domains), len(domains) + len(dimensions)
        parts = {"domains": anywhere[:, :d] + 2 * in_keys(phrases, domains), "dimensions": anywhere[:, d:e], "whole": whole, "styles": anywhere[:, e:]}
        made = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, i])) for i in range(v.shape[1])], names=list(kinds[kind])) for kind, v in parts.items()]
        return pa.StructArray.from_arrays([*made, pa.array(doubtful)], names=[*parts, "doubtful"])

    score.__annotations__ = {"texts": pa.Array, "phrases": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, f"struct<{schema}, doubtful: boolean>")(low, keys)
