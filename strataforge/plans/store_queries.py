"""Queries of intake, write-back, reuse, progress and user rules over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as X
from ..operators.tables import shared_path
from ..sources import intake as I
from ..sources import snapshots as S
from ..streaming import progress as G
from ..streaming import reuse as U
from . import patterns as P
from . import score_queries as O
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.strip()
        return f

    return add


@query("SELECT 'source=' || source AS artifact, 'directory' AS kind, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, true AS success FROM documents GROUP BY 1, 2")
def pip06_intake(spark, sf):
    """Documents written as a folder of text files for each source, then found and taken in as artifacts."""
    path = shared_path(spark, "intake")
    D.table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("value"), "source").write.partitionBy("source").text(path)
    found = I.artifacts(spark, path, content="false").filter(F.col("path").endswith(".txt"))
    return I.intake(found).select("artifact", "kind", "bytes", "success")


@query("SELECT o_custkey AS name, max(o_orderkey) AS last_order, c_name AS label, any_value(c_acctbal) AS balance FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 3 UNION ALL SELECT c_custkey, NULL, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def joi11_merge(spark, sf):
    """Customers as nodes, merged with their newest order: known nodes get a property, unknown ones are added."""
    path = shared_path(spark, "merge")
    S.create(D.table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance")), path, ["name"], buckets=8)
    S.merge(D.table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("last_order")), path, order=["last_order"])
    return S.read(spark, path).select("name", "last_order", "label", "balance")


_ADVISED = " UNION ALL ".join(f"SELECT artifact_name, '{kind}' AS category FROM s WHERE {kind}_score < 0.7 AND {test}" for kind, test, *_ in O._ADVICE)


@query(f"""WITH {O._SQL}, r AS (SELECT artifact_name, count(*) AS n FROM ({_ADVISED}) GROUP BY 1)
SELECT doc_id::VARCHAR AS artifact_name, lang, probability AS evaluation_score, CASE WHEN probability >= 0.8 THEN 'high' WHEN probability >= 0.6 THEN 'medium' ELSE 'low' END AS acceptance_prediction,
  documentation_score AS doc_quality_score, coalesce(n, 0) AS total_recommendations FROM documents JOIN p ON p.artifact_name = doc_id::VARCHAR LEFT JOIN r ON r.artifact_name = p.artifact_name""")
def sco06_score_write_back(spark, sf):
    """Scores, prediction and the number of recommendations written on the artifact nodes, then read back."""
    path = shared_path(spark, "nodes")
    nodes = D.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("artifact_name"), "lang")
    S.create(nodes, path, ["artifact_name"], buckets=8)
    scored = P.predictions(P.scores(P.features(O.artifacts(spark, sf))))
    S.merge(P.evaluated(scored), path, insert=False)
    return S.read(spark, path).select("artifact_name", "lang", "evaluation_score", "acceptance_prediction", "doc_quality_score", "total_recommendations")


_LISTED = " UNION ALL ".join(f"SELECT artifact_name, '{kind}' AS category, '{priority}' AS priority, '{text}' AS advice FROM s WHERE {kind}_score < 0.7 AND {test}" for kind, test, priority, text in O._ADVICE)


@query(f"""WITH {O._SQL}, r AS (SELECT artifact_name, string_agg(priority || ' ' || category || ': ' || advice, '; ' ORDER BY priority, category, advice) AS recommendations FROM ({_LISTED}) GROUP BY 1)
SELECT p.artifact_name, probability AS evaluation_score, coalesce(recommendations, '') AS recommendations FROM p LEFT JOIN r ON r.artifact_name = p.artifact_name""")
def sco07_evaluation_summary(spark, sf):
    """Each artifact's score with its recommendations as one line."""
    scored = P.predictions(P.scores(P.features(O.artifacts(spark, sf))))
    found = P.evaluation_summary(P.evaluated(scored), P.recommendations(scored))
    line = F.transform("recommendations", lambda r: F.concat(r["priority"], F.lit(" "), r["category"], F.lit(": "), r["advice"]))
    return found.select("artifact_name", "evaluation_score", F.array_join(line, "; ").alias("recommendations"))


@query("SELECT DISTINCT coalesce(source, '') AS artifact, sha256(coalesce(text, '')) AS digest FROM documents")
def str01_content_reuse(spark, sf):
    """Contents of each source that are worked on: a stream over the documents, run twice; the second run finds all done."""
    root = shared_path(spark, "reuse")
    docs = D.table(spark, sf, "documents")
    arrived = f"{root}/in"
    for _ in range(2):
        docs.select(F.col("source").alias("artifact"), F.col("doc_id").cast("string").alias("path"), "text").write.mode("append").parquet(arrived)
        U.work(spark.readStream.schema("artifact string, path string, text string").parquet(arrived), "text", f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("artifact", "digest")


@query("SELECT 'read' AS stage, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_errors FROM documents UNION ALL SELECT 'labelled', count(*), count(*) FILTER (WHERE toxic = 1) FROM documents JOIN labels USING (doc_id)")
def str02_progress(spark, sf):
    """Rows and errors of two stages, counted while the plan runs."""
    p = G.Progress()
    docs = p.stage(D.table(spark, sf, "documents"), "read", F.coalesce("text", F.lit("")) == "")
    p.stage(docs.join(D.table(spark, sf, "labels"), "doc_id"), "labelled", F.col("toxic") == 1).write.format("noop").mode("overwrite").save()
    return p.counts(spark)


def _exclamations(text: str) -> float:
    return text.count("!")


def _question_share(text: str) -> float:
    return text.count("?") / len(text)


@query(r"""SELECT doc_id, source, 'exclamations' AS rule, (length(text) - length(replace(text, '!', '')))::DOUBLE AS value FROM documents
UNION ALL SELECT doc_id, source, 'question_share', round((length(text) - length(replace(text, '?', '')))::DOUBLE / nullif(length(text), 0), 9) FROM documents""")
def udf05_user_rules(spark, sf):
    """Two user rules called from SQL over all documents; the share of an empty text fails and is null."""
    X.register_rules(spark, {"exclamations": _exclamations, "question_share": _question_share})
    docs = D.table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    return X.ask(spark, "SELECT doc_id, source, rule, round(value, 9) AS value FROM apply_rules(TABLE(user_documents), text => 'text')", {"user_documents": docs})


@query("SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 1000 GROUP BY 1")
def gq42_text_query(spark, sf):
    """A query given as text, with a parameter, over named views."""
    views = {"all_customers": D.table(spark, sf, "customer"), "all_nations": D.table(spark, sf, "nation")}
    return X.ask(spark, "SELECT n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM all_customers JOIN all_nations ON n_nationkey = c_nationkey WHERE c_acctbal > :least GROUP BY 1", views, least=1000)
