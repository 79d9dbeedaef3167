"""Queries of features, scores, predictions and advice over artifacts dealt from ``documents``, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.strip()
        return f

    return add


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """An artifact for each document: its README is the document's text, the other lists are dealt by its id."""
    d = F.col("doc_id")
    file = lambda keep, path, lines: F.when(keep, F.struct(F.lit(path).alias("path"), lines.alias("content")))
    some = lambda *files: F.filter(F.array(*files), lambda f: f.isNotNull())
    one = F.array(F.lit("x"))
    return D.table(spark, sf, "documents").select(
        d.cast("string").alias("artifact_name"),
        some(file(d % 3 == 0, "docs/guide.md", D._dealt(d, D.PHRASES, 5, 23)), file(d % 4 != 0, "docs/ReadMe.md", F.split(F.coalesce("text", F.lit("")), "\n"))).alias("documentation_files"),
        some(*(file(d % 5 > j, f"f{j}.py", one) for j in range(4))).alias("code_files"),
        some(file(d % 3 == 1, "LICENSE", one)).alias("license_files"),
        some(file(d % 7 == 0, "Dockerfile", one)).alias("docker_files"),
        F.transform(D._dealt(d, D.PATHS, 6, 9), lambda p: F.struct(p.alias("path"))).alias("build_files"),
        some(file(d % 3 == 2, "d.csv", one)).alias("data_files"),
        F.transform(D._dealt(d, D.PATHS, 2, 7), lambda p: F.concat(F.repeat(F.lit("│   "), F.length(p) % 4), F.lit("├── "), p)).alias("tree_structure"),
        F.when(d % 13 != 0, ((d * 37) % 700).cast("double")).alias("repo_size_mb"),
    )


_P = lambda items: ", ".join(f"({i}, '{x}')" for i, x in enumerate(items))
_SAYS = lambda pattern: f"coalesce(regexp_matches(readme, '{pattern}'), false) OR coalesce(regexp_matches(guide, '{pattern}'), false)"
_SQL = rf"""
paths(i, path) AS (VALUES {_P(D.PATHS)}), phrases(i, line) AS (VALUES {_P(D.PHRASES)}),
g AS (SELECT doc_id, lower(string_agg(line, ' ' ORDER BY i) FILTER (WHERE (doc_id * (i + 5) + i) % 97 < 4)) AS said, count(*) FILTER (WHERE (doc_id * (i + 5) + i) % 97 < 4) AS lines FROM documents, phrases GROUP BY 1),
b AS (SELECT doc_id, count(*) FILTER (WHERE (doc_id * (i + 6) + i) % 97 < 10) AS builds, coalesce(bool_or(contains(lower(path), 'requirements')) FILTER (WHERE (doc_id * (i + 6) + i) % 97 < 10), false) AS requirements,
  count(*) FILTER (WHERE (doc_id * (i + 2) + i) % 97 < 13) AS files, coalesce(max(length(path) % 4 + 1) FILTER (WHERE (doc_id * (i + 2) + i) % 97 < 13), 0) AS depth FROM documents, paths GROUP BY 1),
a AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 <> 0 THEN coalesce(text, '') END AS raw, lower(replace(raw, chr(10), ' ')) AS readme, CASE WHEN d.doc_id % 3 = 0 THEN coalesce(said, '') END AS guide, lines, builds, requirements, files, depth
  FROM documents d JOIN g ON d.doc_id = g.doc_id JOIN b ON d.doc_id = b.doc_id),
w AS (SELECT *, coalesce(len(regexp_extract_all(readme, '\b(install|setup|configuration|prerequisite)\b')), 0) + coalesce(len(regexp_extract_all(guide, '\b(install|setup|configuration|prerequisite)\b')), 0) AS words FROM a),
f AS (SELECT doc_id::VARCHAR AS artifact_name, raw IS NOT NULL AS has_readme, doc_id % 3 = 1 AS has_license, doc_id % 7 = 0 AS has_docker, requirements AS has_requirements, doc_id % 3 = 2 AS has_data_files,
  {_SAYS(r"zenodo\.org|doi\.org.*zenodo|10\.5281/zenodo")} AS has_zenodo_doi, {_SAYS("installation|setup|getting started|how to run|usage")} AS has_setup_instructions, {_SAYS("example|demo|tutorial|sample")} AS has_examples,
  files::INT AS total_files, (CASE WHEN doc_id % 3 = 0 THEN lines ELSE 0 END + coalesce(len(string_split(raw, chr(10))), 0))::INT AS documentation_sections, coalesce(length(replace(raw, chr(10), '')), 0)::INT AS readme_length,
  least(doc_id % 5, 4)::INT AS code_files, depth::INT AS tree_depth, CASE WHEN doc_id % 13 <> 0 THEN (doc_id * 37 % 700)::DOUBLE ELSE 0.0 END AS repo_size_mb,
  2 * (doc_id % 7 = 0)::INT + 0.5 * builds + CASE WHEN words > 10 THEN 3 WHEN words > 5 THEN 2 WHEN words > 0 THEN 1 ELSE 0 END AS points, CASE WHEN points <= 2 THEN 'low' WHEN points <= 5 THEN 'medium' ELSE 'high' END AS setup_complexity FROM w),
s AS (SELECT *, round(0.4::DOUBLE * has_readme::INT + 0.3::DOUBLE * (readme_length > 500)::INT + 0.2::DOUBLE * has_license::INT + 0.1::DOUBLE * (documentation_sections > 3)::INT, 6) AS documentation_score,
  round(0.3::DOUBLE * has_docker::INT + 0.3::DOUBLE * has_setup_instructions::INT + 0.2::DOUBLE * has_examples::INT + CASE setup_complexity WHEN 'low' THEN 0.2::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE 0 END, 6) AS reproducibility_score,
  round(0.4::DOUBLE * has_zenodo_doi::INT + 0.3::DOUBLE * has_data_files::INT + 0.3::DOUBLE * (code_files > 0)::INT, 6) AS availability_score,
  round(0.4::DOUBLE * (code_files > 0)::INT + 0.2::DOUBLE * (total_files > 5)::INT + 0.2::DOUBLE * (tree_depth > 2)::INT + 0.2::DOUBLE * (repo_size_mb < 100)::INT, 6) AS structure_score,
  round(greatest(0, 1 - CASE setup_complexity WHEN 'high' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.2::DOUBLE ELSE 0 END - 0.3::DOUBLE * (repo_size_mb > 500)::INT), 6) AS complexity_score FROM f),
p AS (SELECT *, round(0.25::DOUBLE * documentation_score + 0.30::DOUBLE * reproducibility_score + 0.20::DOUBLE * availability_score + 0.15::DOUBLE * structure_score + 0.10::DOUBLE * complexity_score, 6) AS probability FROM s)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return P.scores(P.features(artifacts(spark, sf)))


@query(f"WITH {_SQL} SELECT * EXCLUDE (points) FROM f")
def sco01_features(spark, sf):
    return P.features(artifacts(spark, sf))


_FIVE = [f"{k}_score" for k in P.SCORES]


@query(f"WITH {_SQL} SELECT artifact_name, {', '.join(_FIVE)} FROM s")
def sco02_feature_scores(spark, sf):
    return _scored(spark, sf).select("artifact_name", *_FIVE)


@query(f"WITH {_SQL} SELECT artifact_name, probability, CASE WHEN probability >= 0.8 THEN 'high' WHEN probability >= 0.6 THEN 'medium' ELSE 'low' END AS likelihood, (CASE WHEN probability >= 0.8 THEN 0.9 WHEN probability >= 0.6 THEN 0.7 ELSE 0.6 END)::DOUBLE AS confidence FROM p")
def sco03_predictions(spark, sf):
    return P.predictions(_scored(spark, sf)).select("artifact_name", "probability", "likelihood", "confidence")


_ADVICE = (
    ("documentation", "NOT has_readme", "high", "Add a comprehensive README file explaining the project"),
    ("documentation", "readme_length < 500", "medium", "Expand README with more detailed information"),
    ("reproducibility", "NOT has_docker", "high", "Add Docker configuration for easy environment setup"),
    ("reproducibility", "NOT has_setup_instructions", "high", "Add clear setup and installation instructions"),
    ("availability", "NOT has_zenodo_doi", "medium", "Consider archiving the artifact on Zenodo for persistent access"),
)


@query(f"WITH {_SQL} " + " UNION ALL ".join(f"SELECT artifact_name, '{kind}' AS category, '{priority}' AS priority, '{text}' AS advice FROM s WHERE {kind}_score < 0.7 AND {test}" for kind, test, priority, text in _ADVICE))
def sco04_recommendations(spark, sf):
    return P.recommendations(_scored(spark, sf))


@query(f"WITH {_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS criterion, {c} AS v FROM s" for c in _FIVE) + ") SELECT criterion, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM c GROUP BY 1")
def agg23_score_summary(spark, sf):
    return P.summary(_scored(spark, sf))
