"""Artifact features, scores, predictions and advice; pattern rules over many artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import statistics as S

# Weights of the five scores in the prediction, and the classes of the total.
SCORES = {"documentation": 0.25, "reproducibility": 0.30, "availability": 0.20, "structure": 0.15, "complexity": 0.10}
CLASSES = ((0.8, "high", 0.9), (0.6, "medium", 0.7))
FLAGS = ["has_readme", "has_license", "has_docker", "has_requirements", "has_data_files", "has_zenodo_doi", "has_setup_instructions", "has_examples"]
# What documentation says where it names a DOI of the archive, tells how to set up, or has examples.
ZENODO = r"zenodo\.org|doi\.org.*zenodo|10\.5281/zenodo"
SETUP = "installation|setup|getting started|how to run|usage"
EXAMPLES = "example|demo|tutorial|sample"
#: Marks of a line of a drawn tree, one for each level.
TREE_MARKS = "[│├└]"


def features(artifacts: DataFrame) -> DataFrame:
    """One flat feature row per artifact; missing lists are empty, a missing size is 0.

    Texts are looked at one by one, in lower case, their lines joined by blanks.  total_files is the
    number of lines of the tree, tree_depth the most marks of one line; readme_length counts the first README's characters.
    """
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    empty = F.array().cast("array<string>")
    docs = F.coalesce(F.transform("documentation_files", lambda f: F.lower(F.concat_ws(" ", f["content"]))), empty)
    readmes = F.filter("documentation_files", lambda f: F.lower(f["path"]).contains("readme"))
    says = lambda pattern: F.coalesce(F.exists(docs, lambda d: d.rlike(pattern)), F.lit(False))
    count = lambda array: F.coalesce(F.aggregate(array, F.lit(0), lambda s, x: s + x), F.lit(0))
    flags = {
        "has_readme": n(readmes) > 0,
        "has_license": n("license_files") > 0,
        "has_docker": n("docker_files") > 0,
        "has_requirements": F.exists("build_files", lambda f: F.lower(f["path"]).contains("requirements")),
        "has_data_files": n("data_files") > 0,
        "has_zenodo_doi": says(ZENODO),
        "has_setup_instructions": says(SETUP),
        "has_examples": says(EXAMPLES),
    }
    words = count(F.transform(docs, lambda d: F.regexp_count(d, F.lit(X.SETUP_WORDS))))
    numbers = {
        "total_files": n("tree_structure"),
        "documentation_sections": count(F.transform("documentation_files", lambda f: n(f["content"]))),
        "readme_length": count(F.transform(F.coalesce(F.try_element_at(readmes, F.lit(1))["content"], empty), lambda x: F.length(x))),
        "code_files": n("code_files"),
        "tree_depth": F.coalesce(F.array_max(F.transform("tree_structure", lambda x: F.regexp_count(x, F.lit(TREE_MARKS)))), F.lit(0)),
        "repo_size_mb": F.coalesce("repo_size_mb", F.lit(0.0)),
    }
    setup = X.setup_complexity(words, flags["has_docker"], n("build_files"))
    return artifacts.select("artifact_name", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()), *(c.alias(k) for k, c in numbers.items()), setup.alias("setup_complexity"))


def _on(condition: Column | str, points: float) -> Column:
    return F.when(F.col(condition) if isinstance(condition, str) else condition, points).otherwise(0.0)


def scores(rows: DataFrame) -> DataFrame:
    """Adds the five scores, each from 0 to 1; a ``reviewed`` column (score name to a mark of 10) is averaged in where it has one."""
    setup, size = F.col("setup_complexity"), F.col("repo_size_mb")
    # Points of each score.
    parts = {
        "documentation": _on("has_readme", 0.4) + _on(F.col("readme_length") > 500, 0.3) + _on("has_license", 0.2) + _on(F.col("documentation_sections") > 3, 0.1),
        "reproducibility": _on("has_docker", 0.3) + _on("has_setup_instructions", 0.3) + _on("has_examples", 0.2) + F.when(setup == "low", 0.2).when(setup == "medium", 0.1).otherwise(0.0),
        "availability": _on("has_zenodo_doi", 0.4) + _on("has_data_files", 0.3) + _on(F.col("code_files") > 0, 0.3),
        "structure": _on(F.col("code_files") > 0, 0.4) + _on(F.col("total_files") > 5, 0.2) + _on(F.col("tree_depth") > 2, 0.2) + _on(size < 100, 0.2),
        "complexity": 1.0 - F.when(setup == "high", 0.5).when(setup == "medium", 0.2).otherwise(0.0) - _on(size > 500, 0.3),
    }
    if "reviewed" in rows.columns:
        for k in ("documentation", "reproducibility", "availability"):
            mark = F.try_element_at("reviewed", F.lit(k)) / 10
            parts[k] = F.coalesce((parts[k] + mark) / 2, parts[k])
    return rows.withColumns({f"{k}_score": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 6) for k, v in parts.items()})


def _class(total: Column) -> tuple[Column, Column]:
    kind, sure = F.when(total >= CLASSES[0][0], CLASSES[0][1]), F.when(total >= CLASSES[0][0], CLASSES[0][2])
    for least, name, confidence in CLASSES[1:]:
        kind, sure = kind.when(total >= least, name), sure.when(total >= least, confidence)
    return kind.otherwise("low"), sure.otherwise(0.6)


def predictions(scored: DataFrame) -> DataFrame:
    """Adds probability, likelihood and confidence."""
    total = F.round(sum((F.col(f"{k}_score") * w for k, w in SCORES.items()), F.lit(0.0)), 6)
    kind, sure = _class(F.col("probability"))
    return scored.withColumn("probability", total).withColumn("likelihood", kind).withColumn("confidence", sure)


def recommendations(scored: DataFrame) -> DataFrame:
    """(artifact_name, category, priority, advice) where a score is under 0.7 and what the advice names is missing."""
    short = F.col("readme_length") < 500
    # Score, what is missing, category, priority and text of each advice.
    advice = (
        ("documentation", ~F.col("has_readme"), "documentation", "high", "Add a comprehensive README file explaining the project"),
        ("documentation", short, "documentation", "medium", "Expand README with more detailed information"),
        ("reproducibility", ~F.col("has_docker"), "reproducibility", "high", "Add Docker configuration for easy environment setup"),
        ("reproducibility", ~F.col("has_setup_instructions"), "reproducibility", "high", "Add clear setup and installation instructions"),
        ("availability", ~F.col("has_zenodo_doi"), "availability", "medium", "Consider archiving the artifact on Zenodo for persistent access"),
    )
    rows = [F.when((F.col(f"{score}_score") < 0.7) & missing, F.struct(F.lit(kind).alias("category"), F.lit(priority).alias("priority"), F.lit(text).alias("advice"))) for score, missing, kind, priority, text in advice]
    return scored.select("artifact_name", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("artifact_name", "r.*")


def evaluated(predicted: DataFrame) -> DataFrame:
    """What an evaluation writes on an artifact's node: score, prediction, confidence, the five scores, the number of recommendations.

    ``predicted`` comes from ``predictions``; its artifact names are unique.
    """
    advised = recommendations(predicted).groupBy("artifact_name").agg(F.count("*").alias("n"))
    # Names of the properties.
    names = {"documentation": "doc_quality", "reproducibility": "reproducibility", "availability": "availability", "structure": "code_structure", "complexity": "complexity"}
    return predicted.join(advised, "artifact_name", "left").select(
        "artifact_name",
        F.col("probability").alias("evaluation_score"),
        F.col("likelihood").alias("acceptance_prediction"),
        F.col("confidence").alias("prediction_confidence"),
        *(F.col(f"{k}_score").alias(f"{v}_score") for k, v in names.items()),
        F.coalesce("n", F.lit(0)).alias("total_recommendations"),
    )


def evaluation_summary(nodes: DataFrame, advice: DataFrame) -> DataFrame:
    """Each evaluated artifact with an array of its recommendations, by priority and text; empty if it has none."""
    lists = advice.groupBy("artifact_name").agg(F.sort_array(F.collect_list(F.struct("priority", "category", "advice"))).alias("recommendations"))  # five at most
    kind = "array<struct<priority:string,category:string,advice:string>>"
    return nodes.join(lists, "artifact_name", "left").withColumn("recommendations", F.coalesce("recommendations", F.array().cast(kind)))


def indicators(scored: DataFrame, success: Column, least: float = 0.7) -> DataFrame:
    """(feature, share): flags that more than ``least`` of the successful artifacts have."""
    found = S.prevalence(scored.filter(success), FLAGS, least)
    return found.filter("indicator").select("feature", "share")


def alignment(scored: DataFrame, table: DataFrame) -> DataFrame:
    """(artifact_name, similarity, missing): share of the indicators that each artifact has."""
    long = scored.select("artifact_name", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("has")) for f in FLAGS))).alias("f")).select("artifact_name", "f.*")
    joined = long.join(F.broadcast(table.select("feature")), "feature")  # one row per feature
    return joined.groupBy("artifact_name").agg(F.round(F.avg(F.col("has").cast("double")), 6).alias("similarity"), F.sort_array(F.collect_list(F.when(~F.col("has"), F.col("feature")))).alias("missing"))


def adjusted(predicted: DataFrame, aligned: DataFrame) -> DataFrame:
    """Probability moved by how well an artifact fits the indicators, and its class: a pattern weighs 0.3, a violation 0.05."""
    joined = predicted.join(aligned, "artifact_name", "left")
    shift = 0.3 * F.when(F.col("similarity") > 0.8, 0.2).when(F.col("similarity") > 0.6, 0.1).otherwise(-0.1) - 0.05 * F.coalesce(F.size("missing"), F.lit(0))
    total = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability") + shift)), 6)
    kind, sure = _class(F.col("adjusted"))
    return joined.withColumn("adjusted", total).withColumn("likelihood", kind).withColumn("confidence", sure)


def rules(found: DataFrame, power: DataFrame) -> DataFrame:
    """(kind, feature, text): success factors, warnings and prediction rules from correlations and predictive power."""
    good = found.filter("r > 0.3").select(F.lit("success factor").alias("kind"), "feature", F.format_string("%s goes with acceptance (r = %.2f)", "feature", "r").alias("text"))
    bad = found.filter("r < -0.3").select(F.when(F.col("r") < -0.5, "strong warning").otherwise("warning"), "feature", F.format_string("%s goes with rejection (r = %.2f)", "feature", "r"))
    rule = power.filter("predictive").select(F.lit("prediction"), "feature", F.format_string("accepted %.0f%%, rejected %.0f%%", F.col("success_rate") * 100, F.col("failure_rate") * 100))
    return good.union(bad).union(rule)


def summary(predicted: DataFrame) -> DataFrame:
    """(criterion, mean, min, max) over all artifacts."""
    names = [f"{k}_score" for k in SCORES]
    long = predicted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), F.col(n).alias("v")) for n in names))).alias("x")).select("x.*")
    return long.groupBy("criterion").agg(*(F.round(f("v"), 6).alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
