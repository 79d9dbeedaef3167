"""Reports over the artifact graph: shared types, structure classes, connections and degrees of high-scoring artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G

#: Score above which an artifact counts as a success.
HIGH = 0.7


def is_readme(path: str = "path") -> Column:
    return F.contains(F.lower(path), F.lit("readme"))


def with_readme(files: DataFrame, artifact: str, path: str) -> DataFrame:
    """One row: artifacts with a file whose path names a README."""
    return files.filter(is_readme(path)).agg(F.count_distinct(artifact).alias("with_readme"))


def structure_classes(readmes: DataFrame, sections: str) -> DataFrame:
    """(class, readmes, sections): READMEs by their number of sections, those without any counted as minimal."""
    n = F.coalesce(F.col(sections), F.lit(0))
    kind = F.when(n <= 3, "minimal").when(n <= 6, "standard").when(n <= 10, "detailed").otherwise("comprehensive")
    return readmes.groupBy(kind.alias("class")).agg(F.count("*").alias("readmes"), F.round(F.avg(n), 6).alias("sections"))


def prevalent(rows: DataFrame, artifacts: DataFrame, artifact: str, kind: str, least: float, k: int | None = None) -> DataFrame:
    """(kind, artifacts, percent) of kinds that more than ``least`` of ``artifacts`` have; the ``k`` most common if given."""
    total = artifacts.agg(F.count_distinct(artifact).alias("total"))
    per = rows.groupBy(kind).agg(F.count_distinct(artifact).alias("artifacts"))
    out = per.join(F.broadcast(total)).filter(F.col("artifacts") > F.col("total") * least)  # one row
    out = out.select(kind, "artifacts", F.round(F.col("artifacts") * 100 / F.col("total"), 6).alias("percent"))
    return out if k is None else out.orderBy(F.desc("artifacts"), kind).limit(k)


def shared_types(rows: DataFrame, artifact: str, kind: str, least: int) -> DataFrame:
    """(kind, names, artifacts) of kinds that more than ``least`` artifacts have; names sorted."""
    out = rows.groupBy(kind).agg(F.sort_array(F.collect_set(artifact)).alias("names"))
    return out.withColumn("artifacts", F.size("names").cast("long")).filter(F.col("artifacts") > least)


def connections(artifacts: DataFrame, edges: DataFrame, nodes: DataFrame, least: float = HIGH) -> DataFrame:
    """(id, name, score, type, label, n): edges of each high-scoring artifact by type and target label; one row with nulls and 0 where it has none."""
    high = artifacts.filter(F.col("score") > least).select("id", "name", "score")
    out = edges.select(F.col("src").alias("id"), "type", "dst").join(nodes.select(F.col("id").alias("dst"), "label"), "dst", "left").drop("dst")
    return high.join(out, "id", "left").groupBy("id", "name", "score", "type", "label").agg(F.count("type").alias("n"))


def section_lists(sections: DataFrame, artifact: str, kind: str, section: str) -> DataFrame:
    """(kind, sections, artifacts): how many artifacts have the same sorted list of section types in documents of a kind."""
    lists = sections.groupBy(artifact, kind).agg(F.sort_array(F.collect_list(section)).alias("sections"))
    return lists.groupBy(kind, "sections").agg(F.count("*").alias("artifacts"))


def scores_by_type(rows: DataFrame, artifact: str, kind: str, score: str, least: float = HIGH) -> DataFrame:
    """(kind, artifacts, mean_score) over rows of high-scoring artifacts; a row counts for the mean as often as it stands."""
    return rows.filter(F.col(score) > least).groupBy(kind).agg(F.count_distinct(artifact).alias("artifacts"), F.round(F.avg(score), 6).alias("mean_score"))


def degrees(artifacts: DataFrame, edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(id, score, total, one count a type): outgoing edges of every artifact with a score, 0 where it has none; input of correlations."""
    per = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("total"), *(F.count_if(F.col("type") == t).alias(t) for t in types))
    return artifacts.filter("score is not null").select("id", "score").join(per, "id", "left").fillna(0, ["total", *types])


def rankings(artifacts: DataFrame, files: DataFrame, edges: DataFrame, depth: int, k: int) -> DataFrame:
    """(id, files, rank): the ``k`` artifacts with most files at up to ``depth`` CONTAINS edges, ties by id."""
    reached = G.closure(edges, "CONTAINS", depth).join(files.select(F.col("id").alias("dst")), "dst")
    per = artifacts.select("id").join(reached.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("files")), "id", "left").fillna(0, ["files"])
    return per.orderBy(F.desc("files"), "id").limit(k)


def score_patterns(artifacts: DataFrame, edges: DataFrame, nodes: DataFrame, least: float | None = None, k: int = 20) -> DataFrame:
    """The ``k`` most frequent (type, label) that edges of scored artifacts have: frequency and mean score, an artifact counted at each of its edges; only scores over ``least`` if given."""
    scored = artifacts.filter(F.col("score").isNotNull() if least is None else F.col("score") > least).select(F.col("id").alias("src"), "score")
    ends = nodes.select(F.col("id").alias("dst"), "label")
    rows = edges.select("src", "type", "dst").join(scored, "src").join(ends, "dst").groupBy("type", "label")
    return rows.agg(F.count("*").alias("frequency"), F.round(F.avg("score"), 6).alias("mean_score")).orderBy(F.desc("frequency"), "type", "label").limit(k)
