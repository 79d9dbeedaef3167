"""Queries of the library's own operators over the driver's tables, each with the SQL it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as X
from ..operators import encoder as N
from ..operators import graph as G
from ..operators import hierarchy as Y
from ..operators import keyphrases as H
from ..operators import keywords as K
from ..operators import mentions as W
from ..operators import similarity as V
from ..operators import statistics as S
from ..operators import substrings as B
from ..operators import vector_index as I
from ..operators.tables import shared_path
from . import agent_queries as R
from . import batch_queries as J
from . import graph_queries as T
from . import profile_queries as C
from . import readme_queries as U
from . import score_queries as O
from . import standins as D
from . import store_queries as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = R.QUERIES | C.QUERIES | T.QUERIES | O.QUERIES | U.QUERIES | M.QUERIES | J.QUERIES
ORACLES: dict[str, str] = R.ORACLES | C.ORACLES | T.ORACLES | O.ORACLES | U.ORACLES | M.ORACLES | J.ORACLES


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _r(c, n=6):
    return F.round(c, n)


# --- text signals -----------------------------------------------------------------


@query(r"""
SELECT doc_id, regexp_matches(lower(text), 'mit license|apache license|gpl|lgpl|bsd license|cc-by|creative commons|epl|eupl|mpl|unlicense') AS license,
  regexp_matches(lower(text), 'how to cite|citation|doi:|zenodo|paper url') AS citation, regexp_matches(lower(text), 'author|contributors|maintainers|developer') AS author FROM documents
""")
def fun11_attribution(spark, sf):
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", X.has_any("text", X.LICENSE_WORDS).alias("license"), X.has_any("text", X.CITATION_WORDS).alias("citation"), X.has_any("text", X.AUTHOR_WORDS).alias("author"))


@query(r"""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')))::BIGINT AS table_lines, len(regexp_extract_all(text, '(?m)^[ \t\n\x0B\f\r]*[-*+][ \t\n\x0B\f\r]+'))::BIGINT AS bullets,
  len(regexp_extract_all(text, '(?m)^[ \t\n\x0B\f\r]*[0-9]+\.[ \t\n\x0B\f\r]+'))::BIGINT AS numbered, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)'))::BIGINT AS images FROM documents
""")
def fun10_markdown_features(spark, sf):
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", X.table_lines("text").alias("table_lines"), X.bullet_lines("text").alias("bullets"), X.numbered_lines("text").alias("numbered"), X.images("text").alias("images"))


@query(r"""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_filled,
  len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_words, length(text)::BIGINT AS n_chars FROM documents
""")
def src15_lines(spark, sf):
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", F.size(X.lines("text")).cast("long").alias("n_lines"), F.size(X.filled_lines("text")).cast("long").alias("n_filled"), X.word_count("text").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, sha256(text) AS content_hash, substr(md5('File:' || doc_id), 1, 16) AS node_id FROM documents")
def fun38_ids(spark, sf):
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", F.sha2("text", 256).alias("content_hash"), X.node_id(F.lit("File"), F.col("doc_id").cast("string")).alias("node_id"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS hash FROM documents GROUP BY md5(text)")
def set07_distinct_content(spark, sf):
    t = D.table(spark, sf, "documents")
    return t.groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) <> '' AS valid FROM pages
""")
def fun31_urls(spark, sf):
    t = D.table(spark, sf, "pages")
    scheme, host = X.url_parts("url")
    return t.select("page_id", scheme.alias("scheme"), host.alias("host"), X.is_url("url").alias("valid"))


@query(r"""
SELECT page_id, len(regexp_extract_all(html, '<a [^>]*>'))::BIGINT AS links, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages
""")
def fun07_page_headings(spark, sf):
    t = D.table(spark, sf, "pages")
    return t.select("page_id", F.regexp_count("html", F.lit("<a [^>]*>")).cast("long").alias("links"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


@query(r"""
SELECT source AS artifact, round(avg(CASE WHEN len(w) >= 100 THEN len(list_filter(w, lambda x: list_contains(['api', 'library', 'dataset', 'framework', 'dependency', 'gpu', 'docker', 'virtualenv', 'conda', 'cli', 'shell', 'python', 'server', 'backend', 'runtime', 'build', 'script', 'repository', 'compile', 'kernel'], regexp_replace(x, '[^\pL\pN_]', '', 'g'))))::DOUBLE / len(w) ELSE 0 END), 6) AS jargon
FROM (SELECT source, regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+') AS w FROM documents) GROUP BY 1
""")
def fun16_jargon(spark, sf):
    return D.files(spark, sf).groupBy("artifact").agg(_r(F.avg(X.jargon_ratio("text"))).alias("jargon"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def fun49_json_field(spark, sf):
    t = D.table(spark, sf, "events")
    return t.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM documents) SELECT doc_id, round(" + " + ".join(f"ln(1 + len(list_filter(w, lambda x: x = '{k}')))" for k in ("license", "apache", "mit")) + ", 6) AS score FROM w")
def extra_keyword_agent(spark, sf):
    """The keyword agent that the documentation describes: whole words, log-scaled."""
    return D.table(spark, sf, "documents").select("doc_id", _r(K.word_score("text", ("license", "apache", "mit"))).alias("score"))


# --- files and windows ------------------------------------------------------------


@query("""
WITH f AS (SELECT source AS artifact, doc_id, length(text) AS size, contains(lower(text), 'license') AS important FROM documents WHERE length(text) <= 20000),
n AS (SELECT *, row_number() OVER (PARTITION BY artifact, important ORDER BY doc_id) AS k FROM f)
SELECT artifact, doc_id, important FROM n WHERE important OR k <= 10
""")
def win01_sampled_files(spark, sf):
    """Important files of a directory are all kept, of the others the first ten by name."""
    f = D.files(spark, sf).select("artifact", F.col("file").alias("doc_id"), F.length("text").alias("size"), X.has_any("text", ("license",)).alias("important")).filter("size <= 20000")
    k = F.row_number().over(Window.partitionBy("artifact", "important").orderBy("doc_id"))
    return f.withColumn("k", k).filter("important or k <= 10").select("artifact", "doc_id", "important")


@query("""
SELECT doc_id, line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), n_lines) - line_no AS body_lines
FROM (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, unnest(list_filter(range(len(string_split(text, chr(10)))), lambda i: length(string_split(text, chr(10))[i + 1]) <= 30))::INT AS line_no FROM documents)
""")
def win07_sections(spark, sf):
    """Sections begin at short lines and end at the next one."""
    t = D.table(spark, sf, "documents")
    rows = t.select("doc_id", F.size(X.lines("text")).alias("n_lines"), F.posexplode(X.lines("text")).alias("line_no", "line")).filter(F.length("line") <= 30)
    after = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return rows.select("doc_id", "line_no", (F.coalesce(after, "n_lines") - F.col("line_no")).alias("body_lines"))


@query("SELECT source AS artifact, round(sum(length(text)) / 1048576.0, 2) AS size_mb, max(len(string_split(text, chr(10))))::BIGINT AS longest FROM documents GROUP BY 1")
def agg30_repository_size(spark, sf):
    return D.files(spark, sf).groupBy("artifact").agg(_r(F.sum(F.length("text")) / 1048576.0, 2).alias("size_mb"), F.max(F.size(X.lines("text"))).cast("long").alias("longest"))


# --- weights of venues ------------------------------------------------------------


def _w(sql: str) -> str:
    return f"WITH {D.WEIGHTS_SQL}\n{sql}"


@query(_w("SELECT venue, dimension, round(weight, 6) AS weight, (row_number() OVER (PARTITION BY venue ORDER BY weight DESC, dimension))::INT AS rank FROM weights"))
def win02_dimension_rank(spark, sf):
    return S.ranked(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("SELECT dimension, arg_max(venue, struct_pack(w := weight, v := venue)) AS leader0, string_agg(venue, '>' ORDER BY weight DESC, venue) AS ordered FROM weights GROUP BY 1").replace("arg_max(venue, struct_pack(w := weight, v := venue)) AS leader0", "first(venue ORDER BY weight DESC, venue) AS leader"))
def win03_leaders(spark, sf):
    return S.leaders(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("SELECT venue, dimension, round(weight / max(weight) OVER () * 100, 6) AS importance, round(weight / sum(weight) OVER (), 6) AS share FROM weights"))
def win05_relative_importance(spark, sf):
    w, whole = D.weights(spark, sf), Window.partitionBy()
    return w.select("venue", "dimension", _r(F.col("weight") / F.max("weight").over(whole) * 100).alias("importance"), _r(F.col("weight") / F.sum("weight").over(whole)).alias("share"))


@query(_w("SELECT dimension, round(avg(weight), 6) AS mean, string_agg(CASE WHEN weight > m THEN venue END, ',' ORDER BY venue) AS above, string_agg(CASE WHEN weight < m THEN venue END, ',' ORDER BY venue) AS below FROM (SELECT *, avg(weight) OVER (PARTITION BY dimension) AS m FROM weights) GROUP BY 1"))
def agg07_around_mean(spark, sf):
    return S.around_mean(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("""SELECT dimension, round(avg(weight), 6) AS mean, round(var_pop(weight), 6) AS variance, round(stddev_pop(weight), 6) AS std, round(max(weight) - min(weight), 6) AS range, round(stddev_pop(weight) / avg(weight), 6) AS cv,
CASE WHEN stddev_pop(weight) > 0.1 THEN 'high' WHEN stddev_pop(weight) > 0.05 THEN 'medium' ELSE 'low' END AS level, first(venue ORDER BY weight DESC, venue DESC) AS highest, first(venue ORDER BY weight, venue) AS lowest FROM weights GROUP BY 1"""))
def agg08_variance(spark, sf):
    return S.spread(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("""SELECT dimension, count(weight) AS count, round(avg(weight), 6) AS mean, round(median(weight), 6) AS median, round(stddev_pop(weight), 6) AS std, round(min(weight), 6) AS min, round(max(weight), 6) AS max FROM weights GROUP BY 1"""))
def agg06_basic_statistics(spark, sf):
    return S.basic(D.weights(spark, sf), "weight", ["dimension"])


@query(_w("""SELECT venue, dimension, kind, round(weight, 6) AS weight, round(others, 6) AS others FROM (SELECT *, CASE WHEN weight > 1.2 * others THEN 'emphasised' WHEN weight < 0.8 * others THEN 'reduced' END AS kind FROM
(SELECT *, (sum(weight) OVER d - weight) / (count(weight) OVER d - 1) AS others FROM weights WINDOW d AS (PARTITION BY dimension))) WHERE kind IS NOT NULL"""))
def agg11_unique_traits(spark, sf):
    return S.unique_traits(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("""SELECT venue, dimension, CASE WHEN weight > round(m + s, 9) THEN 'high' WHEN weight < round(m - s, 9) THEN 'low' ELSE 'medium' END AS priority, round(m, 6) AS mean, round(s, 6) AS std FROM (SELECT *, avg(weight) OVER v AS m, stddev_pop(weight) OVER v AS s FROM weights WINDOW v AS (PARTITION BY venue))"""))
def win10_priorities(spark, sf):
    return S.priorities(D.weights(spark, sf), "venue", "dimension", "weight")


@query(_w("""SELECT venue, dimension, round(weight, 6) AS weight, round(e / sum(e) OVER (PARTITION BY venue), 6) AS adjusted FROM (SELECT *, CASE dimension WHEN 'BUILDING' THEN 0.4 WHEN 'MACHINERY' THEN 0.1 ELSE weight END AS e FROM weights)"""))
def joi23_emphasis(spark, sf):
    emphasis = spark.createDataFrame([("BUILDING", 0.4), ("MACHINERY", 0.1)], "dimension string, emphasis double")
    out = S.emphasised(D.weights(spark, sf), "dimension", "weight", emphasis, ["venue"])
    return out.select("venue", "dimension", _r(F.col("weight")).alias("weight"), _r(F.col("adjusted")).alias("adjusted"))


@query(_w("SELECT venue, round(coalesce(greatest(0.0, 1 - stddev_pop(weight) / avg(weight)), 0.0), 6) AS score FROM weights GROUP BY 1"))
def agg14_cross_validation(spark, sf):
    return S.confidence(D.weights(spark, sf), "venue", "weight")


@query(_w("""SELECT venue, count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS std, round(count(*) / 6.0, 6) AS coverage FROM weights GROUP BY 1"""))
def agg10_extraction_confidence(spark, sf):
    w = D.weights(spark, sf)
    return w.groupBy("venue").agg(F.count("*").alias("n"), _r(F.avg("weight")).alias("mean"), _r(F.stddev_samp("weight")).alias("std"), _r(F.count("*") / 6.0).alias("coverage"))


# --- keyword sets and pairs -------------------------------------------------------

_SETS = """s AS (SELECT p_brand AS seg, list_sort(list(DISTINCT p_type || ' ' || p_size)) AS words FROM part GROUP BY 1)"""


def _sets(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_brand").alias("seg"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("word"))
    return K.keyword_sets(p, "seg", "word")


@query(f"""WITH {_SETS} SELECT x.seg AS a, y.seg AS b, len(list_intersect(x.words, y.words))::INT AS shared, len(list_distinct(x.words || y.words))::INT AS "union", (len(x.words) - len(list_intersect(x.words, y.words)))::INT AS only_a,
(len(y.words) - len(list_intersect(x.words, y.words)))::INT AS only_b, round(len(list_intersect(x.words, y.words))::DOUBLE / len(list_distinct(x.words || y.words)), 6) AS jaccard FROM s x JOIN s y ON x.seg < y.seg""")
def joi18_keyword_overlap(spark, sf):
    return K.set_pairs(_sets(spark, sf), "seg")


@query(f"""WITH {_SETS} SELECT round(avg(len(list_intersect(x.words, y.words))::DOUBLE / len(list_distinct(x.words || y.words))), 6) AS consensus, count(*) AS pairs FROM s x JOIN s y ON x.seg < y.seg""")
def agg13_keyword_consensus(spark, sf):
    return K.consensus(K.set_pairs(_sets(spark, sf).withColumn("words", F.col("words")), "seg").withColumn("jaccard", F.col("shared") / F.col("union")))


@query(f"""WITH {_SETS} SELECT array_to_string(list_sort(list_distinct(flatten(list(words)))), ',') AS words FROM s""")
def set03_accumulated(spark, sf):
    return _sets(spark, sf).agg(F.concat_ws(",", K.accumulated(_sets(spark, sf))).alias("words"))


# --- outcome patterns -------------------------------------------------------------


def _f(sql: str) -> str:
    return f"WITH {D.FEATURES_SQL}\n{sql}"


@query(_f("SELECT feature, n, share, share > 0.7 AS indicator FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count_if({c})::BIGINT AS n, round(avg({c}::INT), 6) AS share FROM features" for c in D.FLAGS) + ")"))
def agg15_prevalence(spark, sf):
    return S.prevalence(D.features(spark, sf), D.FLAGS)


@query(
    _f(
        "SELECT feature, r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength, (row_number() OVER (ORDER BY abs(r) DESC, feature))::INT AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(corr({c}, score), 0), 6) AS r FROM features" for c in D.NUMBERS)
        + ")"
    )
)
def agg40_correlations(spark, sf):
    return S.correlations(D.features(spark, sf), "score", D.NUMBERS)


@query(
    _f(
        "SELECT feature, round(abs(r) / sum(abs(r)) OVER (), 6) AS weight FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(corr({c}, score), 0), 6) AS r FROM features" for c in D.NUMBERS)
        + ")"
    )
)
def agg22_pattern_weights(spark, sf):
    return S.correlation_weights(S.correlations(D.features(spark, sf), "score", D.NUMBERS))


@query(
    _f(
        "SELECT feature, round(y, 6) AS success_rate, round(n, 6) AS failure_rate, round(y - n, 6) AS power, y - n > 0.2 AS predictive FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(avg(CASE WHEN accepted THEN {c}::INT END), 0) AS y, coalesce(avg(CASE WHEN NOT accepted THEN {c}::INT END), 0) AS n FROM features" for c in D.FLAGS)
        + ")"
    )
)
def agg41_predictive_power(spark, sf):
    return S.predictive_power(D.features(spark, sf), "accepted", D.FLAGS)


@query(_f("SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 5000 THEN 'long' ELSE 'very long' END AS class, count(*) AS n, round(avg(n_chars), 6) AS mean FROM features GROUP BY 1"))
def agg16_length_classes(spark, sf):
    return S.binned(D.features(spark, sf), "n_chars", [(500, "short"), (2000, "medium"), (5000, "long")], "very long")


@query(_f("SELECT accepted, round(quantile_cont(n_words, 0.25), 6) AS q25, round(quantile_cont(n_words, 0.5), 6) AS q50, round(quantile_cont(n_words, 0.75), 6) AS q75, round(avg(n_words), 6) AS mean FROM features GROUP BY 1"))
def agg17_quartiles(spark, sf):
    return S.quartiles(D.features(spark, sf), "n_words", ["accepted"])


@query(_f("SELECT accepted, count(*) AS n, count_if(has_license)::BIGINT AS licensed, round(avg(n_words), 6) AS words, round(avg(CASE WHEN n_lines > 1 THEN n_lines END), 6) AS lines FROM features GROUP BY 1"))
def gq31_success_split(spark, sf):
    f = D.features(spark, sf)
    return f.groupBy("accepted").agg(F.count("*").alias("n"), F.count_if("has_license").alias("licensed"), _r(F.avg("n_words")).alias("words"), _r(F.avg(F.when(F.col("n_lines") > 1, F.col("n_lines")))).alias("lines"))


# --- joins ------------------------------------------------------------------------


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, bool_or(coalesce(o_orderpriority = '1-URGENT', false)) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def joi06_optional_match(spark, sf):
    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    c = D.table(spark, sf, "customer").select("c_custkey")
    per = o.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("orders"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large FROM customer")
def joi16_existence_flags(spark, sf):
    o = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 300000).alias("large"))
    c = D.table(spark, sf, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_orders"), F.coalesce("large", F.lit(False)).alias("has_large"))


@query("SELECT coalesce(a.k, b.k) AS nation, a.v AS customers, b.v AS suppliers FROM (SELECT c_nationkey k, count(*) v FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) v FROM supplier GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def set05_differences(spark, sf):
    a = D.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = D.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").filter("not (customers <=> suppliers)").select("nation", "customers", "suppliers")


@query("SELECT d.doc_id, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY d.doc_id")
def joi04_analysis_and_evaluation(spark, sf):
    a, e = D.table(spark, sf, "documents").select("doc_id", "n_chars"), D.table(spark, sf, "labels").select("doc_id", "quality")
    return a.join(e, "doc_id").select("doc_id", "quality", "n_chars").orderBy("doc_id")


# --- graph ------------------------------------------------------------------------


def _g(sql: str) -> str:
    return f"WITH {D.GRAPH_SQL}\n{sql}"


@query(_g("SELECT label, count(*) AS n FROM nodes GROUP BY 1"))
def agg29_node_types(spark, sf):
    return G.type_counts(D.nodes(spark, sf), "label")


@query(_g("SELECT type, count(*) AS n FROM edges GROUP BY 1"))
def gq39_edge_types(spark, sf):
    return G.type_counts(D.edges(spark, sf), "type")


@query(_g("SELECT id, label, name, n_in, n_out, degree FROM (SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1) JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 10"))
def gq32_most_connected(spark, sf):
    return G.connected(D.edges(spark, sf), D.nodes(spark, sf), 10).select("id", "label", "name", "n_in", "n_out", "degree")


@query(_g("SELECT e.type, s.label AS src_label, d.label AS dst_label, count(*) AS n FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes d ON e.dst = d.id GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 30"))
def gq21_frequent_relationships(spark, sf):
    return G.frequent(D.edges(spark, sf), D.nodes(spark, sf), 30)


@query(_g("""SELECT src AS region, label, count(*) AS n FROM (SELECT a.src, a.dst FROM edges a WHERE a.type = 'CONTAINS' UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.type = 'CONTAINS' AND b.type = 'CONTAINS') c JOIN nodes ON dst = id WHERE src LIKE 'R%' GROUP BY 1, 2"""))
def joi17_closure(spark, sf):
    c = G.closure(D.edges(spark, sf), "CONTAINS", 3)
    n = D.nodes(spark, sf).select(F.col("id").alias("dst"), "label")
    return c.filter(F.col("src").startswith("R")).join(n, "dst").groupBy(F.col("src").alias("region"), "label").agg(F.count("*").alias("n"))


@query(_g("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, round((SELECT count(*) FROM edges)::DOUBLE / ((SELECT count(*) FROM nodes)::DOUBLE * ((SELECT count(*) FROM nodes) - 1)), 9) AS density"))
def fun45_density(spark, sf):
    n = D.nodes(spark, sf).agg(F.count("*").alias("nodes"))
    e = D.edges(spark, sf).agg(F.count("*").alias("edges"))
    return n.join(e).select("nodes", "edges", _r(G.density(F.col("nodes").cast("double"), F.col("edges").cast("double")), 9).alias("density"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT x.n::VARCHAR AS a, y.n::VARCHAR AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.n::VARCHAR < y.n::VARCHAR GROUP BY 1, 2 HAVING count(*) >= 2""")
def gq23_shared_neighbours(spark, sf):
    line = D.table(spark, sf, "lineitem").join(D.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = line.select(F.col("s_nationkey").cast("string").alias("src"), F.lit("SUPPLIES").alias("type"), F.col("l_partkey").cast("string").alias("dst"))
    return G.co_neighbours(e, "SUPPLIES", 2)


@query("SELECT lang, n, rows, round(n / t, 6) AS share FROM (SELECT lang, count(DISTINCT source) AS n, count(*) AS rows, (SELECT count(DISTINCT source) FROM documents) AS t FROM documents GROUP BY 1) WHERE n / t > 0.5")
def gq14_universal_types(spark, sf):
    return G.common_types(D.table(spark, sf, "documents"), "source", "lang", 0.5)


# --- text statistics and retrieval -----------------------------------------------


@query("SELECT word, count(*) AS n, count(DISTINCT source) AS artifacts FROM (SELECT source, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word IN ('the', 'license', 'und', 'de', 'der', 'for', 'install') GROUP BY 1")
def gq09_common_words(spark, sf):
    words = D.files(spark, sf).select("artifact", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter(F.col("word").isin("the", "license", "und", "de", "der", "for", "install"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("artifact").alias("artifacts"))


_TERMS = r"""u AS (SELECT item_id AS doc, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','this','to','was','were','will','with') AND NOT regexp_full_match(w, '\p{N}+')) AS w FROM benchmark),
c AS (SELECT doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM u),
n AS (SELECT doc, term, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT count(DISTINCT doc) AS docs FROM n),
d AS (SELECT term, count(*) AS df FROM n GROUP BY 1), k AS (SELECT term, ln((1 + docs) / (1 + df)) + 1 AS idf FROM d, t WHERE docs = 1 OR df <= 0.95 * docs),
r AS (SELECT doc, n.term, n * idf AS raw FROM n JOIN k ON n.term = k.term), f AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS tfidf FROM r)"""


@query(f"WITH {_TERMS} SELECT doc, term, round(tfidf, 6) AS tfidf FROM f")
def fun03_tfidf(spark, sf):
    b = D.table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc")
    return K.tfidf(K.terms(b, "doc", "text"), "doc").select("doc", "term", _r(F.col("tfidf")).alias("tfidf"))


@query(f"""WITH {_TERMS}, s(dimension, keyword) AS (VALUES ('x', 'erer'), ('x', 'onre'), ('y', 'onre'), ('y', 'inin'), ('z', 'nowhere')), b AS (SELECT term, sum(tfidf) AS v FROM f GROUP BY 1),
q AS (SELECT dimension, coalesce(sum(v), 0.0) AS score, count(v) AS n_terms FROM (SELECT DISTINCT * FROM s) LEFT JOIN b ON term = keyword GROUP BY 1)
SELECT dimension, round(score, 6) AS score, n_terms, round(CASE WHEN sum(score) OVER () = 0 THEN 0 ELSE score / sum(score) OVER () END, 6) AS weight FROM q""")
def agg05_criteria(spark, sf):
    b = D.table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc")
    seeds = spark.createDataFrame([("x", "1", "erer"), ("x", "2", "onre"), ("y", "1", "onre"), ("y", "2", "inin"), ("z", "1", "nowhere")], "dimension string, category string, keyword string")
    out = K.keyword_scores(K.tfidf(K.terms(b, "doc", "text"), "doc"), seeds)
    return out.select("dimension", _r(F.col("score")).alias("score"), "n_terms", _r(F.col("weight")).alias("weight"))


@query("""SELECT query, rank::INT AS rank, vec_id, round(score, 5) AS score FROM (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 5""")
def srt07_vector_top_k(spark, sf):
    e = D.table(spark, sf, "embeddings")
    out = V.top_k(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 5)  # the stated query set
    return out.select("query", "rank", "vec_id", _r(F.col("score"), 5).alias("score"))


@query()
def rag01_vector_index(spark, sf):
    """The 20 nearest rows of every vector whose id is divisible by 20, by an index built over all vectors; tests measure its recall."""
    e, path = D.table(spark, sf, "embeddings"), shared_path(spark, "vector-index")
    I.build(e, "vec_id", "embedding", path)
    return I.search(e.filter("vec_id % 20 = 0"), "vec_id", "embedding", path, 20).select("query", "rank", F.col("key").alias("vec_id"), _r(F.col("score"), 5).alias("score"))


_TOKENS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3 AND w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','he','in','is','it','its','of','on','that','the','this','to','was','were','will','with') AND NOT regexp_full_match(w, '\p{N}+')) AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(i)), k AS (SELECT word FROM p GROUP BY 1 HAVING count(*) >= 5),
c AS (SELECT a.word, b.word AS context, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.i <> b.i AND abs(a.i - b.i) <= 4 WHERE a.word IN (FROM k) AND b.word IN (FROM k) GROUP BY 1, 2),
o AS (SELECT word, sum(n) AS own FROM c GROUP BY 1), m AS (SELECT c.*, ln(n * (SELECT sum(own) FROM o) / (o.own::DOUBLE * q.own)) AS ppmi FROM c JOIN o USING (word) JOIN o q ON c.context = q.word)"""


@query(f"WITH {_TOKENS} SELECT word, context, n::BIGINT AS n, round(ppmi, 6) AS ppmi FROM m WHERE ppmi > 0")
def fun05_word_associations(spark, sf):
    """The matrix that the encoder factors, over all documents."""
    return N.associations(N.cooccurrences(D.table(spark, sf, "documents"), "text")).select("word", "context", "n", _r(F.col("ppmi")).alias("ppmi"))


@query()
def fun05_encoded_texts(spark, sf):
    """A vector for each document, by an encoder fitted on all of them; tests hold it against a dense factorisation."""
    docs = D.table(spark, sf, "documents")
    return N.encode(docs, "doc_id", "text", N.fit(docs, "text")).select("doc_id", "n_words", F.transform("vector", lambda x: _r(x)).alias("vector"))


@query()
def fun04_key_phrases(spark, sf):
    """20 key phrases of one or two words of each document by maximal marginal relevance; tests hold the choice against a plain loop."""
    docs = D.table(spark, sf, "documents")
    return H.phrases(docs, "doc_id", "text", N.fit(docs, "text"))


@query()
def agg36_profiles_by_key_phrases(spark, sf):
    """Venue profiles of all documents, whose key phrases the encoder gives (``agg36_venue_profiles`` has long words in their place)."""
    from . import profiles

    docs = D.table(spark, sf, "documents")
    found = H.phrases(docs, "doc_id", "text", N.fit(docs, "text")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("keys"))
    texts = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return profiles.profiles(texts.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>"))), "doc_id", "text", "keys").drop("emphasis")


@query(f"WITH {D.MENTIONS_SQL} SELECT artifact, type, target, n FROM e")
def joi02_named_files(spark, sf):
    """DESCRIBES and MENTIONS edges of every document to the files and folders of its artifact that it names."""
    return W.edges(D.readmes(spark, sf), "artifact", "document", "text", D.artifact_files(spark, sf), "path").select("artifact", "type", "target", "n")


_LANGUAGES = ", ".join(f"('{e}', '{n}')" for e, n in P.LANGUAGES.items())


@query(f"""WITH {D.MENTIONS_SQL}, l(x, language) AS (VALUES {_LANGUAGES}), c AS (SELECT artifact, coalesce(language, 'unknown') AS language, lower(regexp_extract(regexp_extract(target, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS file_type FROM e LEFT JOIN l ON x = lower(regexp_extract(regexp_extract(target, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) WHERE type = 'DESCRIBES')
SELECT language, file_type, count(DISTINCT artifact) AS artifact_count, count(*) AS total_references FROM c GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 10""")
def gq06_code_references(spark, sf):
    links = W.edges(D.readmes(spark, sf), "artifact", "document", "text", D.artifact_files(spark, sf), "path")
    return W.code_references(links, P.language("target"), P.extension("target"))


@query(f"WITH {D.MENTIONS_SQL} SELECT target AS directory_name, count(DISTINCT artifact) AS artifact_count, count(*) AS total_mentions FROM e WHERE type = 'MENTIONS' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15")
def gq07_directory_mentions(spark, sf):
    return W.directory_references(W.edges(D.readmes(spark, sf), "artifact", "document", "text", D.artifact_files(spark, sf), "path"))


@query("""WITH v AS (SELECT p_name AS term, min(p_partkey) AS o FROM part GROUP BY 1), s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS seed FROM part UNION SELECT upper(substr(p_name, 2, 6)) FROM part UNION SELECT p_name || 's' FROM part UNION SELECT substr(p_type, 1, 2) FROM part),
r AS (SELECT seed, term, row_number() OVER (PARTITION BY seed ORDER BY o, term) AS place FROM s, v WHERE contains(lower(term), lower(seed)) OR contains(lower(seed), lower(term)))
SELECT seed, term, place::INT AS place FROM r WHERE place <= 5""")
def joi14_seed_terms(spark, sf):
    """The first five part names, in the order of the table, that hold a seed or that a seed holds."""
    part = D.table(spark, sf, "part")
    seeds = part.select(F.explode(F.split("p_name", " ")).alias("seed"))
    for made in (F.upper(F.substring("p_name", 2, 6)), F.concat("p_name", F.lit("s")), F.substring("p_type", 1, 2)):
        seeds = seeds.union(part.select(made))
    return B.expanded(seeds, "seed", part, "p_name", "p_partkey")


@query("""WITH a AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM documents)
SELECT a.w AS seed, count(*) AS terms, max(b.w) AS last FROM a JOIN b ON contains(b.w, a.w) WHERE a.w <> '' GROUP BY 1""")
def joi14_words_within_words(spark, sf):
    """For every word of the benchmark, how many distinct words of all documents hold it."""
    one, two = (D.table(spark, sf, t).select(F.explode(F.split(F.lower("text"), " ")).alias("w")) for t in ("benchmark", "documents"))
    return B.contained(one.filter("w <> ''"), "w", two, "w").groupBy(F.col("needle").alias("seed")).agg(F.count("*").alias("terms"), F.max("hay").alias("last"))


_LINKS = """l AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS dim_a, y.label AS dim_b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND x.label <> y.label)"""


def _keyword_vectors(spark, sf):
    return D.table(spark, sf, "embeddings")


@query(f"WITH {_LINKS} SELECT a, b, dim_a, dim_b, round(similarity, 5) AS similarity FROM l WHERE similarity > 0.4")
def joi08_cross_dimension_links(spark, sf):
    return V.keyword_links(_keyword_vectors(spark, sf), "vec_id", "label", "embedding", 0.4).withColumn("similarity", _r(F.col("similarity"), 5))


@query(f"WITH {_LINKS} SELECT a, b, dim_a, dim_b, round(similarity, 5) AS similarity FROM l WHERE similarity > 0.35 AND (least(dim_a, dim_b), greatest(dim_a, dim_b)) IN ((0, 1), (2, 3), (4, 5))")
def joi09_contradictions(spark, sf):
    links = V.keyword_links(_keyword_vectors(spark, sf), "vec_id", "label", "embedding", 0.35)
    return V.conflicts(links, [(0, 1), (2, 3), (4, 5)], 0.35).withColumn("similarity", _r(F.col("similarity"), 5))


@query(f"WITH {_LINKS} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM l WHERE similarity > 0.35 UNION ALL SELECT b FROM l WHERE similarity > 0.35) GROUP BY 1")
def ml02_degrees(spark, sf):
    return V.degrees(V.keyword_links(_keyword_vectors(spark, sf), "vec_id", "label", "embedding", 0.35), "a", "b")


@query()
def pip02_semantic_hierarchy(spark, sf):
    """The single-linkage joins of all vectors of different dimensions that are similar; a test holds them against a sequential forest."""
    links = V.keyword_links(_keyword_vectors(spark, sf), "vec_id", "label", "embedding", 0.35)
    return Y.spanning_forest(links.withColumn("height", F.round(1 - F.col("similarity"), 9)), "a", "b", "height").withColumn("height", _r(F.col("height"), 5))


@query(f"""WITH RECURSIVE {_LINKS}, s AS (SELECT a, b FROM l WHERE similarity > 0.45 UNION SELECT b, a FROM l WHERE similarity > 0.45),
r(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other) SELECT node, min(other) AS cluster FROM r GROUP BY 1""")
def pip02_clusters_at_a_height(spark, sf):
    """Single-linkage clusters at height 0.55, cut from the hierarchy."""
    e = _keyword_vectors(spark, sf)
    links = V.keyword_links(e, "vec_id", "label", "embedding", 0.35).withColumn("height", 1 - F.col("similarity"))
    return Y.cut(e, "vec_id", Y.spanning_forest(links, "a", "b", "height"), 0.55)


@query("""SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS context, count(*) AS turns FROM conversations GROUP BY 1""")
def rag03_context(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), F.substring("text", 1, 500)).alias("line"))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("t"))
    return per.select("conv_id", F.concat_ws("\n", F.transform("t", lambda x: x["line"])).alias("context"), F.size("t").cast("long").alias("turns"))


@query("SELECT p_brand AS heading, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1 ORDER BY n DESC, heading LIMIT 20")
def srt01_top_headings(spark, sf):
    return D.table(spark, sf, "part").groupBy(F.col("p_brand").alias("heading")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("kinds")).orderBy(F.desc("n"), "heading").limit(20)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_positive, round(100.0 * count_if(value > 0) / count(*), 6) AS percent FROM events GROUP BY 1")
def agg24_feature_statistics(spark, sf):
    e = D.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), _r(F.avg(F.when(F.col("value") > 0, F.col("value")))).alias("mean_positive"), _r(100.0 * F.count_if(F.col("value") > 0) / F.count("*")).alias("percent"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str01_hourly_events(spark, sf):
    from ..streaming import events as E

    e = D.table(spark, sf, "events")
    return E.hourly(e).select("hour", "event_type", "n", F.round("total", 4).alias("total"))


_SIGNALS = ", ".join("(" + " OR ".join(f"contains(low, '{w}')" for w in words) + f") AS {name}" for name, words in X.SIGNALS.items())


@query(rf"""WITH t AS (SELECT doc_id, lower(text || ' ' || {{}}) AS low FROM documents) SELECT doc_id, regexp_matches(low, 'python\s+\w+\.py|python3\s+\w+\.py|\./\w+\.sh|\.\./\w+\.sh') AS example_commands, {_SIGNALS} FROM t""".format(D.SIGNAL_SQL))
def fun13_documentation_signals(spark, sf):
    """The signals of FUN13, FUN14 and FUN15 in all documents, each followed by a phrase that its id deals."""
    t = D.table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit(" "), D.signal_phrase()))
    return t.select("doc_id", *(c.alias(k) for k, c in X.signals("text").items()))


@query(f"""WITH {D.KINDS_SQL} SELECT doc_id, path, excluded, important, build, data, config, language FROM k""")
def prj05_file_kinds(spark, sf):
    """Kinds of the paths that every document's artifact is dealt (PRJ05, PRJ06, PRJ08, PRJ11, PRJ15)."""
    kinds = {"excluded": P.excluded("path"), "important": P.is_important("path"), "build": P.is_build("path"), "data": P.is_data("path"), "config": P.is_config("path"), "language": P.language("path")}
    return D.dealt_paths(spark, sf).select("doc_id", "path", *(c.alias(k) for k, c in kinds.items()))


# --- more graph and score queries ----------------------------------------------------


@query(_g("""SELECT src_label, dst_label, type, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM (SELECT s.label AS src_label, d.label AS dst_label, e.type, count(*) AS n FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes d ON e.dst = d.id GROUP BY 1, 2, 3)"""))
def gq25_traffic(spark, sf):
    counts = G.endpoints(D.edges(spark, sf), D.nodes(spark, sf)).groupBy("src_label", "dst_label", "type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(_g("""SELECT label, count(*) AS nodes, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) JOIN nodes USING (id) GROUP BY 1"""))
def gq22_centrality(spark, sf):
    per = G.degree(D.edges(spark, sf)).join(D.nodes(spark, sf).select("id", "label"), "id")
    return per.groupBy("label").agg(F.count("*").alias("nodes"), _r(F.avg("degree")).alias("mean_degree"), F.max("degree").alias("max_degree"))


@query(_g("""SELECT n.name AS nation, count(DISTINCT CASE WHEN m.label = 'Customer' THEN m.id END) AS customers, count(DISTINCT CASE WHEN m.label = 'Supplier' THEN m.id END) AS suppliers FROM nodes n LEFT JOIN edges e ON e.src = n.id AND e.type = 'CONTAINS' LEFT JOIN nodes m ON e.dst = m.id WHERE n.label = 'Nation' GROUP BY 1"""))
def grb07_artifact_metrics(spark, sf):
    nodes, edges = D.nodes(spark, sf), D.edges(spark, sf).filter("type = 'CONTAINS'").select("src", "dst")
    per = edges.join(nodes.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src").agg(F.count_if(F.col("label") == "Customer").alias("customers"), F.count_if(F.col("label") == "Supplier").alias("suppliers"))
    out = nodes.filter("label = 'Nation'").join(per, F.col("id") == F.col("src"), "left")
    return out.select(F.col("name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT source AS artifact, min(doc_id) AS readme, CASE WHEN arg_min(n_chars, doc_id) < 500 THEN 'short' WHEN arg_min(n_chars, doc_id) < 2000 THEN 'medium' ELSE 'long' END AS class FROM documents GROUP BY 1")
def gq11_readme_length(spark, sf):
    t = D.table(spark, sf, "documents").groupBy(F.col("source").alias("artifact")).agg(F.min("doc_id").alias("readme"), F.min_by("n_chars", "doc_id").alias("n"))
    return t.select("artifact", "readme", F.when(F.col("n") < 500, "short").when(F.col("n") < 2000, "medium").otherwise("long").alias("class"))


@query("SELECT class, count(*) AS artifacts, round(avg(n), 6) AS mean FROM (SELECT source, count(*) AS n, CASE WHEN count(*) < 40 THEN 'few' WHEN count(*) < 60 THEN 'some' ELSE 'many' END AS class FROM documents GROUP BY 1) GROUP BY 1")
def gq13_file_count_class(spark, sf):
    per = D.files(spark, sf).groupBy("artifact").agg(F.count("*").cast("double").alias("n"))
    return S.binned(per, "n", [(40, "few"), (60, "some")], "many").withColumnRenamed("n", "artifacts")


@query("SELECT lang AS language, source AS artifact, count(*) AS files, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM documents GROUP BY 1, 2")
def gq28_files_by_language(spark, sf):
    per = D.table(spark, sf, "documents").groupBy(F.col("lang").alias("language"), F.col("source").alias("artifact")).agg(F.count("*").alias("files"))
    return S.shares(per, "files", ["artifact"], "share").withColumn("share", _r(F.col("share")))


@query(_f("SELECT is_english, has_tables, count(*) AS n, round(avg(score), 6) AS mean_score FROM features GROUP BY 1, 2"))
def gq33_patterns_with_score(spark, sf):
    return D.features(spark, sf).groupBy("is_english", "has_tables").agg(F.count("*").alias("n"), _r(F.avg("score")).alias("mean_score"))


@query(_f("""SELECT a.doc_id AS a, b.doc_id AS b, round(((a.has_license = b.has_license)::INT + (a.is_english = b.is_english)::INT + (a.is_long = b.is_long)::INT + (a.has_tables = b.has_tables)::INT + (a.flagged = b.flagged)::INT) / 5.0, 6)::DOUBLE AS similarity FROM features a JOIN features b ON b.doc_id IN (SELECT doc_id FROM features WHERE accepted ORDER BY n_words DESC, doc_id LIMIT 5) AND a.doc_id <> b.doc_id"""))
def joi19_top_accepted(spark, sf):
    f = D.features(spark, sf)
    top = f.filter("accepted").orderBy(F.desc("n_words"), "doc_id").limit(5).select(F.col("doc_id").alias("b"))
    pairs = f.select(F.col("doc_id").alias("a")).join(F.broadcast(top), F.col("a") != F.col("b"))  # five rows
    return V.feature_similarity(f, pairs, "doc_id", D.FLAGS)


@query("SELECT event_type, user_id, n, rank::INT AS rank FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 5")
def srt06_top_five(spark, sf):
    per = D.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return per.withColumn("rank", rank).filter("rank <= 5")


@query("SELECT regexp_extract(p_type, '([A-Z]+)$', 1) AS extension, count(*) AS n, count(DISTINCT p_brand) AS folders FROM part GROUP BY 1")
def agg19_extension_counts(spark, sf):
    t = D.table(spark, sf, "part").select(F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("extension"), "p_brand")
    return t.groupBy("extension").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("folders"))


@query("SELECT lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS key, count(*) AS n FROM conversations GROUP BY 1")
def agg25_first_words(spark, sf):
    c = D.table(spark, sf, "conversations")
    return c.groupBy(F.lower(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 3))).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS turns, count_if(length(text) > 0)::BIGINT AS filled, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY 1")
def agg26_run_statistics(spark, sf):
    c = D.table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.length("text") > 0).alias("filled"), _r(F.avg(F.length("text"))).alias("mean"))


@query(f"WITH {D.WEIGHTS_SQL} SELECT x.venue AS a, y.venue AS b, round(sum(x.weight * y.weight) / (sqrt(sum(x.weight * x.weight)) * sqrt(sum(y.weight * y.weight))), 6) AS similarity FROM weights x JOIN weights y ON x.dimension = y.dimension AND x.venue < y.venue GROUP BY 1, 2")
def ml05_venue_similarity(spark, sf):
    """Cosine of the numeric weight vectors of every two venues (25 nations)."""
    w = D.weights(spark, sf)
    x, y = w.select(F.col("venue").alias("a"), "dimension", F.col("weight").alias("x")), w.select(F.col("venue").alias("b"), "dimension", F.col("weight").alias("y"))
    both = x.join(y, "dimension").filter("a < b").groupBy("a", "b")
    cos = F.sum(F.col("x") * F.col("y")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y"))))
    return both.agg(_r(cos).alias("similarity"))
