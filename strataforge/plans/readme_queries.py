"""Queries of README sections dealt from ``documents``: each line is a section's text, and phrases are its heading and end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifact_graph as A
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.strip()
        return f

    return add


#: Headings and ends of sections: the phrases of the stand-in artifacts and some that join words of several groups.
SAID = (*D.PHRASES, "Getting Started", "Example output", "Contributing", "Bibtex reference", "Results and findings", "Replication guide", "copy and paste this", "step by step, follow it", "run the command", "docker container", "from zenodo: data/x.csv", "API reference", "Legal", "Corpus")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """(artifact, path, idx, heading, type, body)."""
    n, said = len(SAID), F.split(F.lit("\n".join(SAID)), "\n")
    rows = D.table(spark, sf, "documents").select(F.col("doc_id").alias("artifact"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "line"))
    pick = lambda step: F.element_at(said, ((F.col("artifact") * step + F.col("idx") * 7) % n + 1).cast("int"))
    rows = rows.select("artifact", F.lit("README.md").alias("path"), "idx", pick(1).alias("heading"), F.concat("line", F.lit(" "), pick(3)).alias("body"))
    return rows.withColumn("type", A.section_type("heading"))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _case(groups: dict[str, tuple[str, ...]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any('heading', words)} THEN '{name}'" for name, words in groups.items()) + f" ELSE {other} END"


_SQL = f"""
said(i, phrase) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(SAID))}),
l AS (SELECT doc_id AS artifact, idx - 1 AS idx, lines[idx] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(idx)),
h AS (SELECT artifact, idx, x.phrase AS heading, line || ' ' || y.phrase AS body FROM l JOIN said x ON x.i = (artifact + idx * 7) % {len(SAID)} JOIN said y ON y.i = (artifact * 3 + idx * 7) % {len(SAID)}),
e AS (SELECT artifact, idx, heading, {_case(A.SECTION_TYPES, "'general'")} AS type, length(body) AS content_length, {_case(A.NORMAL_HEADINGS, "heading")} AS normalized, {", ".join(f"{_any('body', words)} AS {k}" for k, words in A.SECTION_FLAGS.items())},
  CASE {" ".join(f"WHEN contains(lower(body), '{a}') AND contains(lower(body), '{b}') THEN '{k}'" for k, (a, b) in A.INSTRUCTIONS.items())} WHEN length(body) > 200 THEN 'detailed' WHEN length(body) > 50 THEN 'moderate' ELSE 'brief' END AS instruction FROM h),
m AS (SELECT *, artifact % 10 / 10.0::DOUBLE AS score, normalized = 'installation' AS m1, has_docker_reference AS m2, normalized = 'citation' AND has_data_link AS m3, normalized = 'results' AS m4, has_reproducibility_terms AS m5 FROM e)"""
_MOTIFS = tuple(A.MOTIFS)


def _rich(spark: SparkSession, sf: str) -> DataFrame:
    return A.enriched(sections(spark, sf))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("artifact"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("score"))


@query(f"WITH {_SQL} SELECT type, count(*) AS n, count(DISTINCT heading) AS headings FROM e GROUP BY 1")
def prj17_section_types(spark, sf):
    return sections(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("heading").alias("headings"))


@query(f"WITH {_SQL} SELECT artifact, idx::INT AS idx, normalized, content_length::INT AS content_length, {', '.join(A.SECTION_FLAGS)}, instruction FROM e")
def gq03_enriched_sections(spark, sf):
    return _rich(spark, sf).select("artifact", "idx", "normalized", "content_length", *A.SECTION_FLAGS, "instruction")


@query(f"""WITH {_SQL}, p AS (SELECT artifact, count(*) AS total, count_if(normalized IN ('installation', 'usage', 'examples', 'results', 'reproduction')) AS structured, count_if(has_reproducibility_terms) AS terms, bool_or(normalized = 'installation') AS i, bool_or(normalized = 'usage') AS u,
bool_or(normalized = 'examples') AS x, bool_or(normalized = 'results') AS r, bool_or(normalized = 'reproduction') AS q, bool_or(has_code_snippet) AS c, bool_or(has_script_reference) AS s, bool_or(has_data_link) AS d FROM e GROUP BY 1)
SELECT CASE WHEN q AND r AND s THEN 'replication-heavy' WHEN x AND u AND c THEN 'tutorial' WHEN r AND d THEN 'benchmark' WHEN total <= 3 THEN 'summary-only' WHEN u AND i THEN 'standard' ELSE 'other' END AS archetype, count(*) AS n, round(avg(total), 6) AS sections, round(avg(structured), 6) AS structured, round(avg(terms), 6) AS reproducibility FROM p GROUP BY 1""")
def gq04_readme_archetypes(spark, sf):
    return A.archetypes(_rich(spark, sf))


@query(f"""WITH {_SQL}, p AS (SELECT artifact, count(*) AS n_sections, sum(content_length) AS total, avg(content_length) AS mean, bool_or(instruction IN ('step-by-step', 'copy-paste-ready')) AS high,
20 * bool_or(normalized = 'installation')::INT + 15 * bool_or(normalized = 'usage')::INT + 10 * bool_or(normalized = 'examples')::INT + 10 * bool_or(normalized = 'results')::INT + 5 * bool_or(normalized = 'citation')::INT + 15 * bool_or(has_code_snippet)::INT + 10 * bool_or(has_script_reference)::INT
+ 5 * bool_or(has_data_link)::INT + 5 * bool_or(has_docker_reference)::INT + 5 * bool_or(has_reproducibility_terms)::INT + CASE WHEN sum(content_length) > 1000 THEN 10 ELSE sum(content_length) // 100 END AS raw FROM e GROUP BY 1)
SELECT artifact, least(raw, 100)::INT AS score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 80 THEN 'B' WHEN raw >= 70 THEN 'C' WHEN raw >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN high THEN 'high' WHEN mean > 200 THEN 'medium' ELSE 'low' END AS instruction, n_sections FROM p""")
def gq17_readme_quality(spark, sf):
    return A.readme_quality(_rich(spark, sf)).drop("path")


@query(f"WITH {_SQL}, k AS (" + " UNION ALL ".join(f"SELECT '{name}' AS motif, artifact, content_length FROM m WHERE m{i} AND score > 0.7" for i, name in enumerate(_MOTIFS, 1)) + ") SELECT motif, count(DISTINCT artifact) AS artifacts, count(*) AS occurrences, round(avg(content_length), 6) AS mean_length, round(count(DISTINCT artifact) / 20 * 100, 6)::DOUBLE AS strength, count(DISTINCT artifact) / 20 * 100 > 50 AS strong FROM k GROUP BY 1")
def gq18_readme_motifs(spark, sf):
    """Motifs of the artifacts whose score is over 0.7."""
    return A.motif_strengths(_rich(spark, sf).join(_scores(spark, sf).filter("score > 0.7"), "artifact"))


@query(f"WITH {_SQL}, c AS (SELECT artifact, any_value(score) AS score, {', '.join(f'bool_or(m{i}) AS m{i}' for i in range(1, 6))} FROM m WHERE score > 0.7 GROUP BY 1), d AS (SELECT artifact, score, {' + '.join(f'm{i}::INT' for i in range(1, 6))} AS motif_count, concat_ws(' + ', " + ", ".join(f"CASE WHEN m{i} THEN '{name}' END" for i, name in enumerate(_MOTIFS, 1)) + ") AS pattern FROM c) SELECT * FROM d WHERE motif_count >= 2 ORDER BY motif_count DESC, score DESC, artifact LIMIT 10")
def gq19_composite_motifs(spark, sf):
    good = _scores(spark, sf).filter("score > 0.7")
    return A.composite_motifs(A.motifs(_rich(spark, sf), good), good)
