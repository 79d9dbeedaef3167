"""Queries of the graph reports over the driver's tables, each with the SQL it equals.

Documents stand for files of the artifact that their source names, their language for the kind, their lines for
sections. Where scores count, customers are the artifacts, their suppliers the neighbours, the supplier's nation the type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph_reports as H
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.strip()
        return f

    return add


_FILES = "f AS (SELECT source AS artifact, doc_id, lang, text, CASE WHEN doc_id % 3 = 0 THEN 'docs/ReadMe.md' ELSE 'notes.md' END AS path FROM documents)"
_SCORED = f"{D.GRAPH_SQL}, a AS (SELECT 'C' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 9 > 0 THEN round((c_acctbal + 1000) / 11000, 6) END AS score FROM customer)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    t = D.table(spark, sf, "documents")
    return t.select(F.col("source").alias("artifact"), "doc_id", "lang", "text", F.when(F.col("doc_id") % 3 == 0, "docs/ReadMe.md").otherwise("notes.md").alias("path"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, score) of customers; one in nine has no score."""
    score = F.round((F.col("c_acctbal") + 1000) / 11000, 6)
    return D.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 > 0, score).alias("score"))


@query(f"WITH {_FILES} SELECT count(DISTINCT artifact) AS with_readme FROM f WHERE path = 'docs/ReadMe.md'")
def gq02_with_readme(spark, sf):
    return H.with_readme(_files(spark, sf), "artifact", "path")


@query(f"""WITH {_FILES}, n AS (SELECT coalesce(len(string_split(text, chr(10))), 0) AS n FROM f WHERE path = 'docs/ReadMe.md')
SELECT CASE WHEN n <= 3 THEN 'minimal' WHEN n <= 6 THEN 'standard' WHEN n <= 10 THEN 'detailed' ELSE 'comprehensive' END AS class, count(*) AS readmes, round(avg(n), 6) AS sections FROM n GROUP BY 1""")
def gq10_structure_classes(spark, sf):
    readmes = _files(spark, sf).filter(H.is_readme()).select(F.size(F.split("text", "\n")).alias("n"))
    return H.structure_classes(readmes, "n")


@query("""WITH d AS (SELECT o_custkey AS artifact, o_orderpriority || '/' || quarter(o_orderdate) AS name FROM orders), n AS (SELECT count(DISTINCT artifact) AS total FROM d)
SELECT name, count(DISTINCT artifact) AS artifacts, round(count(DISTINCT artifact) * 100 / first(total), 6) AS percent FROM d, n GROUP BY 1 HAVING count(DISTINCT artifact) > first(total) * 0.3 ORDER BY artifacts DESC, name LIMIT 10""")
def gq15_prevalent_directories(spark, sf):
    """Customers as artifacts, the priority and quarter of their orders as directory names."""
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("artifact"), F.concat_ws("/", "o_orderpriority", F.quarter("o_orderdate").cast("string")).alias("name"))
    return H.prevalent(o, o, "artifact", "name", 0.3, 10)


@query("SELECT lang, count(DISTINCT source) AS artifacts, round(count(DISTINCT source) * 100 / (SELECT count(DISTINCT source) FROM documents), 6) AS percent FROM documents WHERE n_chars > 5000 GROUP BY 1 HAVING count(DISTINCT source) > (SELECT count(DISTINCT source) FROM documents) * 0.4")
def gq16_prevalent_document_types(spark, sf):
    """Long documents are the documentation whose types count."""
    t = D.table(spark, sf, "documents")
    return H.prevalent(t.filter("n_chars > 5000"), t, "source", "lang", 0.4)


@query("SELECT p_brand AS kind, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, count(DISTINCT n_name) AS artifacts FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(DISTINCT n_name) > 2")
def gq24_shared_types(spark, sf):
    """Nations as artifacts, brands of returned parts as their dependency types."""
    line = D.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    part, supplier, nation = (D.table(spark, sf, n) for n in ("part", "supplier", "nation"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = H.shared_types(rows.select(F.col("p_brand").alias("kind"), "n_name"), "n_name", "kind", 2)
    return out.withColumn("names", F.concat_ws(",", "names"))


@query(f"WITH {_SCORED} SELECT a.id, a.name, a.score, e.type, n.label, count(e.type) AS n FROM a LEFT JOIN edges e ON e.src = a.id LEFT JOIN nodes n ON e.dst = n.id WHERE score > 0.7 GROUP BY ALL")
def gq26_high_score_connections(spark, sf):
    return H.connections(_scored(spark, sf), D.edges(spark, sf), D.nodes(spark, sf))


@query("SELECT lang, array_to_string(l, '|') AS sections, count(*) AS artifacts FROM (SELECT conv_id % 2 AS lang, conv_id, list_sort(list(role)) AS l FROM conversations GROUP BY 1, 2) GROUP BY 1, 2")
def gq27_section_lists(spark, sf):
    """Conversations as documents of two kinds, the roles of their turns as section types."""
    c = D.table(spark, sf, "conversations").select("conv_id", (F.col("conv_id") % 2).alias("lang"), "role")
    return H.section_lists(c, "conv_id", "lang", "role").withColumn("sections", F.concat_ws("|", "sections"))


@query(f"WITH {_SCORED}, r AS (SELECT a.id, score, s_nationkey AS kind FROM a JOIN edges ON src = a.id JOIN supplier ON dst = 'S' || s_suppkey) SELECT kind, count(DISTINCT id) AS artifacts, round(avg(score), 6) AS mean_score FROM r WHERE score > 0.7 GROUP BY 1")
def gq29_dependency_types(spark, sf):
    suppliers = D.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("dst"), F.col("s_nationkey").alias("kind"))
    rows = _scored(spark, sf).join(D.edges(spark, sf).filter("type = 'ORDERED'"), F.col("id") == F.col("src")).join(suppliers, "dst")
    return H.scores_by_type(rows, "id", "kind", "score")


@query(f"WITH {_SCORED} SELECT a.id, a.score, count(src) AS total, count_if(coalesce(type = 'ORDERED', false))::BIGINT AS \"ORDERED\", count_if(coalesce(type = 'CONTAINS', false))::BIGINT AS \"CONTAINS\" FROM a LEFT JOIN edges ON src = a.id WHERE score IS NOT NULL GROUP BY 1, 2")
def gq30_degrees(spark, sf):
    return H.degrees(_scored(spark, sf), D.edges(spark, sf), ("ORDERED", "CONTAINS"))


@query(f"WITH {D.GRAPH_SQL}, r AS (SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'CONTAINS' AND b.type = 'CONTAINS' UNION SELECT src, dst FROM edges WHERE type = 'CONTAINS') SELECT n.id, count(m.id) AS files FROM nodes n LEFT JOIN r ON r.src = n.id LEFT JOIN nodes m ON r.dst = m.id AND m.label = 'Customer' WHERE n.label IN ('Region', 'Nation') GROUP BY 1 ORDER BY files DESC, 1 LIMIT 20")
def gq37_size_ranking(spark, sf):
    """Regions and nations by the customers below them."""
    n = D.nodes(spark, sf)
    return H.rankings(n.filter("label in ('Region', 'Nation')"), n.filter("label = 'Customer'"), D.edges(spark, sf), 2, 20)


_PATTERNS = "SELECT type, label, count(*) AS frequency, round(avg(score), 6) AS mean_score FROM a JOIN edges ON src = a.id JOIN nodes n ON dst = n.id WHERE score {} GROUP BY 1, 2 ORDER BY frequency DESC, 1, 2 LIMIT {}"


@query(f"WITH {_SCORED} " + _PATTERNS.format("IS NOT NULL", 20))
def gq33_relationship_patterns(spark, sf):
    return H.score_patterns(_scored(spark, sf), D.edges(spark, sf), D.nodes(spark, sf))


@query(f"WITH {_SCORED} " + _PATTERNS.format("> 0.7", 15))
def gq33_high_score_patterns(spark, sf):
    return H.score_patterns(_scored(spark, sf), D.edges(spark, sf), D.nodes(spark, sf), H.HIGH, 15)
