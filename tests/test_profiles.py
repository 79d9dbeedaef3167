"""Venue profiles: scores by hand, hard rows, lookup, the file round trip."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataforge import settings
from strataforge.plans import profiles as V
from strataforge.sources import readers, sinks

STRICT = "Rigorous, thorough and complete review. Software code must build; the user-friendly setup should run. Users reuse software."


def by_hand(text, words):
    return sum(text.lower().count(w) + len(re.findall(rf"\b{re.escape(w)}\b", text.lower())) for w in words)


@pytest.fixture(scope="module")
def made(spark):
    rows = [("A", STRICT, None), ("B", "minimal and basic", ["neural network", "x"]), ("C", "", []), ("D", None, None), ("E", "Größe reuse résumé testé " * 20_000, None)]
    return {r["name"]: r for r in V.profiles(spark.createDataFrame(rows, "n string, t string, k array<string>"), "n", "t", "k").collect()}


def test_profiles_by_hand(made):
    a = made["A"]
    counts = {d: by_hand(STRICT, words) for d, words in V.DIMENSIONS.items()}
    assert a["emphasis"] == pytest.approx({d: n / sum(counts.values()) for d, n in counts.items()})
    assert (a["category"], a["style"], a["threshold"], a["top_emphasis"]) == ("software_engineering", "strict", 0.8, "usability")
    assert (made["B"]["category"], made["B"]["style"], made["B"]["threshold"]) == ("machine_learning", "lenient", 0.5)
    text = "Größe reuse résumé testé " * 20_000
    counts = {d: by_hand(text, words) for d, words in V.DIMENSIONS.items()}
    assert made["E"]["emphasis"] == pytest.approx({d: n / sum(counts.values()) for d, n in counts.items()})


def test_profiles_of_nothing(made):
    for name in "CD":
        r = made[name]
        assert set(r["emphasis"].values()) == {1 / 6} and r["style"] == "moderate" and r["category"] == "software_engineering"
        assert (r["text_length"], r["n_guidelines"], r["top_emphasis"]) == (0, 1, "reproducibility")


def test_lookup(spark):
    known = spark.createDataFrame([("ICSE", 0), ("CHI", 1), ("ICSE_SEIP", 2)], "name string, place int")
    names = spark.createDataFrame([("icse",), ("CHI 2025",), ("SEIP",), ("none",), ("icse",), (None,)], "name string")
    got = {r["name"]: (r["profile"], r["match"]) for r in V.lookup(names, "name", known, "place").collect()}
    assert got == {"icse": ("ICSE", "exact"), "CHI 2025": ("CHI", "partial"), "SEIP": ("ICSE_SEIP", "partial"), "none": (None, "default"), None: (None, "default")}


def test_profiles_round_trip(spark, tmp_path):
    rows = V.profiles(spark.createDataFrame([("A", STRICT), ("B", None)], "n string, t string"), "n", "t")
    sinks.profiles(rows, str(tmp_path / "p"))
    back = readers.profiles(spark, str(tmp_path / "p"))
    assert all(isinstance(r["generated"], datetime) for r in back.collect())
    assert {tuple(r[c] for c in ("name", "style", "threshold")) for r in back.collect()} == {("A", "strict", 0.8), ("B", "moderate", 0.7)}
    assert {r["name"]: r["emphasis"] for r in back.collect()} == {r["name"]: r["emphasis"] for r in rows.collect()}


def test_recommendations(spark):
    w = spark.createDataFrame([("x", "a", 0.9), ("y", "a", 0.1), ("x", "b", 0.1), ("y", "b", 0.1)], "venue string, dimension string, weight double")
    found = V.consistency(w, "venue", "dimension", "weight")
    assert {tuple(r) for r in found.collect()} == {("a", 0.5, 0.4, "y", "x", "high"), ("b", 0.1, 0.0, "x", "x", "low")}
    pairs = spark.createDataFrame([(0.5,), (0.3,)], "jaccard double")
    assert [r[0] for r in V.recommendations(found, "dimension", pairs, "jaccard").collect()] == ["High variance detected in a across conferences - consider conference-specific evaluation"]


def test_settings(tmp_path):
    made = settings.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": 4})
    assert made == {"a": {"b": 9, "c": 2}, "d": 4}
    config = settings.Settings({"batch": {"workers": 4, "keep": False}, "name": "x"}, ranges={"batch.workers": (1, 32)})
    assert config.get("batch.workers") == 4 and config.get("batch.none", 7) == 7 and config.get("name.deep", 1) == 1
    assert config.with_values({"batch": {"workers": 8}}).get("batch.workers") == 8 and config.get("batch.workers") == 4
    with pytest.raises(KeyError):
        config.with_values({"batch": {"speed": 1}})
    with pytest.raises(ValueError):
        config.with_values({"batch": {"workers": 64}})
    env = {"BATCH_WORKERS": "6", "BATCH_KEEP": "Yes", "OTHER": "1"}
    moved = config.with_environment({"BATCH_WORKERS": "batch.workers", "BATCH_KEEP": "batch.keep"}, env)
    assert moved.get("batch.workers") == 6 and moved.get("batch.keep") is True
    assert config.with_environment({"BATCH_WORKERS": "batch.workers"}, {"BATCH_WORKERS": "many"}).get("batch.workers") == 4
    path = tmp_path / "s.json"
    moved.save(str(path))
    assert config.with_file(str(path)).values == moved.values and config.with_file(str(tmp_path / "none.json")).values == config.values


def test_words_are_looked_for_by_two_letters_before_the_boundary():
    for words in V.DIMENSIONS.values():
        pattern = V.whole_words(words)
        assert pattern.startswith("(?U)(?=[") and all(re.search(pattern.removeprefix("(?U)"), f"a {w}.") and not re.search(pattern.removeprefix("(?U)"), f"x{w}x") for w in words)
    assert "octet_length" in V._occurrences("low", "use")


def test_scores_are_those_of_the_rules_without_a_scan_a_word(spark):
    rng, words = random.Random(3), [w for part in (*V.DOMAINS.values(), *V.DIMENSIONS.values(), *(w for w, _ in V.STYLES.values())) for w in part]
    glue = [" ", "\n", "-", "_", "é", "ß", "x", "\u2019", "\u0301", "\u24d0", "\u200d", "²", "7", ".", "\u00a0", "\u2003", "\x1f", ""]
    texts = ["".join(rng.choice(words) + rng.choice(glue) + rng.choice(["", " ", " the "]) for _ in range(25)) for _ in range(150)]
    texts += [None, "", " ", "data processing data processingdata  processing", "Useuse USE use-use \u0301use", "\u0130use of user\tstudy user study"]
    keys = [[rng.choice(words)[: rng.randint(0, 20)] + rng.choice(["", " ", "s", " model"]) for _ in range(5)] + [None] * (i % 2) for i in range(len(texts) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(range(len(texts)), texts, keys, strict=True)), "i long, t string, k array<string>").repartition(3)
    low, lowered = F.lower(F.coalesce("t", F.lit(""))), F.transform(F.coalesce("k", F.array().cast("array<string>")), F.lower)
    plain = rows.select("i", low.alias("l"), lowered.alias("q")).select("i", *(F.struct(*(c.cast("long").alias(n) for n, c in part.items())) for part in (V.domain_scores("l", "q"), V.emphasis_scores("l"), V.style_counts("l"))))
    got = V.prepared(rows, "t", "k").select("i", "__domains", "__dimensions", "__styles")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" not in plan and plan.count("regexp_count") + plan.count("regexp_extract_all") <= 6
