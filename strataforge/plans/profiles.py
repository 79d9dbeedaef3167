"""Venue profiles from guideline texts: domain, emphasis on dimensions, style; lookup by name; confidence and consistency of criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.occurrences import scores
from ..operators.substrings import either_way

# Words of each domain, in order (the first of equal domains wins).
DOMAINS = {
    "software_engineering": ("software", "code", "programming", "development", "testing", "debugging", "version control", "build", "compilation", "deployment", "maintenance", "requirements", "design", "architecture", "engineering", "methodology"),
    "data_systems": ("database", "query", "storage", "data processing", "indexing", "transaction", "performance", "scalability", "distributed", "parallel", "optimization", "throughput", "latency", "system", "framework", "platform"),
    "human_computer_interaction": ("user", "interface", "interaction", "usability", "accessibility", "design", "user experience", "user study", "evaluation", "human factors", "ergonomics", "prototype", "visualization", "mobile", "web", "application"),
    "machine_learning": ("learning", "algorithm", "model", "training", "prediction", "classification", "regression", "neural", "network", "deep", "feature", "dataset", "accuracy", "performance", "optimization", "validation", "evaluation"),
    "systems_architecture": ("architecture", "system", "performance", "scalability", "distributed", "parallel", "concurrent", "memory", "processor", "hardware", "benchmark", "evaluation", "optimization", "efficiency", "resource"),
    "security": ("security", "privacy", "encryption", "authentication", "authorization", "vulnerability", "attack", "defense", "cryptography", "protocol", "threat", "risk", "compliance", "audit", "forensics"),
}
# Words of each dimension. None is a whole-word part of another of its dimension.
DIMENSIONS = {
    "reproducibility": ("reproduce", "replication", "reproducible", "replicate", "repeat", "validation", "verify", "confirm", "independent", "results"),
    "documentation": ("documentation", "readme", "guide", "manual", "tutorial", "instruction", "description", "explanation", "comment", "annotation", "help"),
    "accessibility": ("accessible", "available", "public", "open", "free", "download", "repository", "archive", "access", "obtain", "retrieve"),
    "usability": ("usable", "easy", "simple", "user-friendly", "intuitive", "straightforward", "install", "setup", "configure", "run", "execute", "use"),
    "experimental": ("experiment", "evaluation", "benchmark", "test", "analysis", "study", "empirical", "statistical", "measurement", "metric", "comparison"),
    "functionality": ("functional", "function", "work", "operate", "perform", "execute", "implement", "feature", "capability", "behavior", "correct"),
}
# Words and quality threshold of each style.
STYLES = {
    "strict": (("rigorous", "comprehensive", "thorough", "detailed", "complete"), 0.8),
    "moderate": (("adequate", "sufficient", "appropriate", "reasonable"), 0.7),
    "lenient": (("minimal", "basic", "simple", "straightforward"), 0.5),
}
# Full names of venues and what they are called.
SHORT_NAMES = {"INTERNATIONAL CONFERENCE ON SOFTWARE ENGINEERING": "ICSE", "ACM SIGMOD": "SIGMOD", "HUMAN FACTORS IN COMPUTING SYSTEMS": "CHI", "VERY LARGE DATA BASES": "VLDB", "PROGRAMMING LANGUAGE DESIGN": "PLDI"}
# The profile of a venue that has none.
DEFAULT_CATEGORY, DEFAULT_THRESHOLD, DEFAULT_STYLE = "general", 0.7, "moderate"
DEFAULT_EMPHASIS = {"reproducibility": 0.25, "documentation": 0.20, "accessibility": 0.15, "usability": 0.15, "experimental": 0.15, "functionality": 0.10}
# What a dimension's keywords are about, the first that has one of them.
FOCUS = {
    "technical_implementation": ("code", "software", "algorithm", "implementation", "system"),
    "process_methodology": ("process", "workflow", "setup", "installation", "configuration"),
    "quality_assurance": ("quality", "performance", "accuracy", "validation", "verification"),
    "accessibility_openness": ("public", "available", "accessible", "open", "free"),
}


def _sum(parts) -> Column:
    return sum(parts, F.lit(0).cast("long"))


def _first_most(scores: dict[str, Column]) -> Column:
    """The name with the highest score, the first of equals."""
    return F.array_max(F.array(*(F.struct(c.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, c) in enumerate(scores.items()))))["name"]


def prepared(rows: DataFrame, text: str, keywords: str | None = None) -> DataFrame:
    """Adds what the rules below read, each computed once a row: scores of domains and dimensions, counts of styles (__domains, __dimensions, __styles).

    They are those of ``domain_scores``, ``emphasis_scores`` and ``style_counts``, the rules as columns, without a scan of each text a word.
    A null text counts as empty. ``keywords`` names an array of the venue's own key phrases, which a replaceable extractor gives.
    """
    keys = F.array().cast("array<string>") if keywords is None else F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), F.lower)
    lowered = rows.withColumns({"__low": F.lower(F.coalesce(F.col(text), F.lit(""))), "__keys": keys})
    found = lowered.withColumn("__found", scores("__low", "__keys", DOMAINS, DIMENSIONS, {name: words for name, (words, _) in STYLES.items()}))
    # the pattern reads only texts whose whole words are in doubt
    alone = {name: F.when(F.col("__found.doubtful"), F.regexp_count("__low", F.lit(whole_words(words))).cast("long")).otherwise(F.col("__found.whole")[name]) for name, words in DIMENSIONS.items()}
    dimensions = {name: F.col("__found.dimensions")[name] + n for name, n in alone.items()}
    counted = found.withColumns({"__domains": F.col("__found.domains"), "__dimensions": _struct(dimensions), "__styles": F.col("__found.styles")})
    return counted.drop("__low", "__keys", "__found")


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(name) for name, c in parts.items()))


def _fields(column: str, names) -> dict[str, Column]:
    return {name: F.col(column)[name] for name in names}


def _occurrences(column: str, word: str) -> str:
    """Of an ASCII word: bytes, whose number Spark knows, stand for characters, which it would have to count."""
    return f"(octet_length({column}) - octet_length(replace({column}, '{word}', ''))) div {len(word)}"


def whole_words(words: tuple[str, ...]) -> str:
    """Pattern of the words standing alone; two letters are looked at before the boundary, which is dear."""
    first, second = ("".join(sorted({w[i] for w in words})) for i in (0, 1))
    return rf"(?U)(?=[{first}][{second}])\b(?:{'|'.join(words)})\b"


def _total(terms: list[str]) -> Column:
    """A long sum as one SQL text: the driver builds it in one call instead of several a word."""
    return F.expr(" + ".join(terms))


def domain_scores(low: str, keys: str) -> dict[str, Column]:
    """Score of each domain: occurrences of its words, and 2 for each (keyword, word) of which one holds the other."""
    touching = lambda w: f"2 * size(filter({keys}, k -> contains(k, '{w}') or contains('{w}', k)))"
    return {name: _total([t for w in words for t in (_occurrences(low, w), touching(w))]) for name, words in DOMAINS.items()}


def emphasis_scores(low: str) -> dict[str, Column]:
    """Per dimension: occurrences of its words anywhere, and again of those that stand as whole words."""
    return {name: _total([_occurrences(low, w) for w in words]) + F.regexp_count(low, F.lit(whole_words(words))) for name, words in DIMENSIONS.items()}


def style_counts(low: str) -> dict[str, Column]:
    return {name: _total([_occurrences(low, w) for w in words]) for name, (words, _) in STYLES.items()}


def domain() -> Column:
    """Of ``prepared`` rows, the domain with the highest score, the first of equals."""
    return _first_most(_fields("__domains", DOMAINS))


def shares() -> dict[str, Column]:
    """Of ``prepared`` rows, each dimension's share of all scores, equal shares where no word occurs."""
    scores = _fields("__dimensions", DIMENSIONS)
    total = _sum(scores.values())
    return {name: F.coalesce(F.try_divide(c, total), F.lit(1 / len(scores))) for name, c in scores.items()}


def emphasis(rows: DataFrame, key: str) -> DataFrame:
    """(key, dimension, score, weight) of ``prepared`` rows."""
    parts = [F.struct(F.lit(d).alias("dimension"), F.col("__dimensions")[d].alias("score"), F.round(w, 6).alias("weight")) for d, w in shares().items()]
    return rows.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.dimension", "x.score", "x.weight")


def style() -> Column:
    """Of ``prepared`` rows: strict or lenient where its words outnumber both others, else moderate."""
    n = _fields("__styles", STYLES)
    return F.when((n["strict"] > n["moderate"]) & (n["strict"] > n["lenient"]), "strict").when((n["lenient"] > n["moderate"]) & (n["lenient"] > n["strict"]), "lenient").otherwise("moderate")


def threshold(style: Column | str) -> Column:
    s = F.col(style) if isinstance(style, str) else style
    return F.when(s == "strict", STYLES["strict"][1]).when(s == "lenient", STYLES["lenient"][1]).otherwise(STYLES["moderate"][1])


def profiles(rows: DataFrame, name: str, text: str, keywords: str | None = None) -> DataFrame:
    """One profile a row: name, category, emphasis map, top_emphasis, style, threshold, text_length, n_guidelines.

    A null or empty text has equal emphasis and a moderate style, and the first domain unless keywords say another.
    """
    weights = F.map_from_entries(F.array(*(F.struct(F.lit(d), w) for d, w in shares().items())))
    whole = F.coalesce(F.col(text), F.lit(""))
    top = _first_most(_fields("__dimensions", DIMENSIONS))
    out = prepared(rows, text, keywords).select(F.col(name).alias("name"), domain().alias("category"), weights.alias("emphasis"), top.alias("top_emphasis"), style().alias("style"), F.length(whole).cast("long").alias("text_length"), F.size(F.split(whole, "\n")).cast("long").alias("n_guidelines"))
    return out.withColumn("threshold", threshold("style"))


def lookup(names: DataFrame, name: str, known: DataFrame, order: str) -> DataFrame:
    """(name, profile, match): the profile of that name in upper case, else the first in ``order`` of which one name holds the other, else none ('default').

    Only names without an exact match, each once, are looked up by containment, through an index of trigrams.
    """
    asked = names.select(F.col(name).alias("name"), F.upper(name).alias("__up")).distinct()
    held = known.select(F.col("name").alias("profile"), F.col(order).alias("__order"))
    exact = asked.join(held.select("profile").distinct(), F.col("__up") == F.col("profile"), "left")
    rest = exact.filter("profile is null").select("name", "__up")
    pairs = either_way(rest, "__up", held, "profile").toDF("__up", "profile")
    near = rest.join(pairs, "__up").join(held, "profile").groupBy("name").agg(F.min_by("profile", F.struct("__order", "profile")).alias("near"))
    out = exact.join(near, "name", "left")
    match = F.when(F.col("profile").isNotNull(), "exact").when(F.col("near").isNotNull(), "partial").otherwise("default")
    return out.select("name", F.coalesce("profile", "near").alias("profile"), match.alias("match"))


def normal_name(name: Column | str) -> Column:
    """A venue's short name: that of the first full name it holds, else itself in upper case without outer blanks."""
    up = F.trim(F.upper(F.col(name) if isinstance(name, str) else name))
    return F.coalesce(*(F.when(F.contains(up, F.lit(full)), short) for full, short in SHORT_NAMES.items()), up)


def focus(keywords: Column | str) -> Column:
    """What a list of keywords is about; 'general' for no keywords, 'general_compliance' where none is known."""
    k = F.col(keywords) if isinstance(keywords, str) else keywords
    known = F.coalesce(*(F.when(F.arrays_overlap(k, F.array(*map(F.lit, words))), name) for name, words in FOCUS.items()), F.lit("general_compliance"))
    return F.when(k.isNull() | (F.size(k) == 0), "general").otherwise(known)


def reliability(confidence: Column | str) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def criteria_confidence(consensus: Column, cross_validation: Column, n_sources: Column) -> Column:
    """Weighted mean of coverage, keyword consensus, cross-validation and two constants: coherence 0.7, stability 0.8."""
    coverage = F.when(n_sources > 0, 1.0).otherwise(0.0)
    return coverage * 0.2 + consensus * 0.3 + F.lit(0.7) * 0.2 + F.lit(0.8) * 0.2 + cross_validation * 0.1


def consistency(weights: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Per item: mean, deviation, the groups with least and most weight (the first by name of equals), level."""
    w = F.col(weight)
    out = weights.groupBy(item).agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min_by(group, F.struct(w, group)).alias("least"), F.min_by(group, F.struct(-w, group)).alias("most"))
    return out.select(item, F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", F.when(F.col("std") > 0.1, "high").otherwise("low").alias("level"))


def recommendations(found: DataFrame, item: str, overlaps: DataFrame, ratio: str) -> DataFrame:
    """One row a recommendation: items of high variance, and whether some pair shares under 0.3 of its keywords."""
    high = found.filter("level = 'high'").agg(F.concat_ws(", ", F.sort_array(F.collect_list(item))).alias("items")).filter("items <> ''")
    low = overlaps.filter(F.col(ratio) < 0.3).agg(F.count("*").alias("n")).filter("n > 0")
    first = high.select(F.concat(F.lit("High variance detected in "), "items", F.lit(" across conferences - consider conference-specific evaluation")).alias("recommendation"))
    return first.union(low.select(F.lit("Low keyword overlap detected between some conference pairs - domain-specific criteria recommended")))


def tree_depth(lines: Column | str) -> Column:
    """Most box-drawing marks in a line of a directory tree, 0 for none."""
    c = F.col(lines) if isinstance(lines, str) else lines
    marks = F.transform(c, lambda x: F.length(x) - F.length(F.translate(x, "│├└", "")))
    return F.coalesce(F.array_max(marks), F.lit(0)).cast("long")


def comparison(scores: DataFrame, name: str, score: str, names: DataFrame) -> DataFrame:
    """One row over the artifacts that ``names`` lists: how many, their mean score, the best, counts of high, medium and low; a null score is 0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    kept = scores.join(names.select(name).distinct(), name, "left_semi")
    return kept.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias("mean"), F.min_by(name, F.struct(-s, name)).alias("best"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium"), F.count_if(s < 0.6).alias("low"))


# Installation signs of a document.
INSTALL_HEADING = r"(?i)#+\s*(installation|setup|how to install|install|install requirements)"
DEPENDENCY_WORDS = ("dependencies", "requirements", "pip install", "conda install", "npm install", "npm", "pip")
ENVIRONMENT_WORDS = ("python 3", "windows", "linux", "macos", "ubuntu", "os support")


def installation_signs(files: DataFrame, artifact: str, path: str, text: str) -> DataFrame:
    """Per artifact: files named for installing, with such headings, such words, dependencies, environments."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    named = F.contains(F.lower(F.substring_index(path, "/", -1)), F.lit("install"))
    tests = {"named": named, "with_headings": F.coalesce(F.col(text), F.lit("")).rlike(INSTALL_HEADING), "with_text": X.has_any(low, ("installation", "setup")), "with_dependencies": X.has_any(low, DEPENDENCY_WORDS), "with_environment": X.has_any(low, ENVIRONMENT_WORDS)}
    return files.groupBy(artifact).agg(F.count("*").alias("files"), *(F.count_if(t).alias(k) for k, t in tests.items()))


def heading_counts(files: DataFrame, file: str, text: str) -> DataFrame:
    """(heading, n, files): occurrences of each heading and the files that have it."""
    return files.select(file, F.explode(X.headings(text)).alias("heading")).groupBy("heading").agg(F.count("*").alias("n"), F.count_distinct(file).alias("files"))


def top_headings(counts: DataFrame, k: int = 100) -> DataFrame:
    return counts.orderBy(F.desc("n"), "heading").limit(k)
