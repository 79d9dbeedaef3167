"""Queries of venue profiles, criteria confidence and document statistics, each with the SQL it equals.

The SQL counts in its own way: whole words as items of a word list (with a hyphen, by a pattern), where the
operators scan one pattern a dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keywords as K
from ..operators import statistics as S
from . import profiles as V
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql.strip()
        return f

    return add


def _words(named: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"({i}, '{name}', '{w}')" for i, (name, words) in enumerate(named.items()) for w in words)


_KEYWORDS = "[a-z]{12,}"
_TEXTS = f"t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '{_KEYWORDS}') AS keys, regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL\\pM\\pN_]+') AS words FROM documents)"
_COUNT = "((length(low) - length(replace(low, w, ''))) // length(w))"
_DOMAINS = f"""d(i, domain, w) AS (VALUES {_words(V.DOMAINS)}),
scored AS (SELECT doc_id, i, domain, sum({_COUNT} + 2 * len(list_filter(keys, lambda k: contains(k, w) OR contains(w, k))))::BIGINT AS score FROM t, d GROUP BY ALL),
domains AS (SELECT doc_id, first(domain ORDER BY score DESC, i) AS category, max(score) AS score FROM scored GROUP BY 1)"""
_EMPHASIS = f"""e(i, dimension, w) AS (VALUES {_words(V.DIMENSIONS)}),
counted AS (SELECT doc_id, i, dimension, sum({_COUNT} + CASE WHEN contains(w, '-') THEN len(regexp_extract_all(regexp_replace(low, '([^\\pL\\pM\\pN_])', '\\1\\1', 'g'), '(^|[^\\pL\\pM\\pN_])' || replace(w, '-', '--') || '($|[^\\pL\\pM\\pN_])'))
  ELSE len(list_filter(words, lambda x: x = w)) END)::BIGINT AS score FROM t, e GROUP BY ALL),
emphasis AS (SELECT doc_id, i, dimension, score, CASE WHEN sum(score) OVER (PARTITION BY doc_id) > 0 THEN score / sum(score) OVER (PARTITION BY doc_id) ELSE 1 / 6.0 END AS weight FROM counted)"""
_STYLES = f"""y(i, style, w) AS (VALUES {_words({k: w for k, (w, _) in V.STYLES.items()})}),
n AS (SELECT doc_id, sum(CASE WHEN i = 0 THEN {_COUNT} ELSE 0 END)::BIGINT AS strict, sum(CASE WHEN i = 1 THEN {_COUNT} ELSE 0 END)::BIGINT AS moderate, sum(CASE WHEN i = 2 THEN {_COUNT} ELSE 0 END)::BIGINT AS lenient FROM t, y GROUP BY 1),
styles AS (SELECT *, CASE WHEN strict > moderate AND strict > lenient THEN 'strict' WHEN lenient > moderate AND lenient > strict THEN 'lenient' ELSE 'moderate' END AS style FROM n)"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as guideline texts; their long words stand for key phrases."""
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", "text", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_KEYWORDS), 0).alias("keys"))


@query(f"WITH {_TEXTS}, {_DOMAINS} SELECT doc_id, category, score FROM domains")
def agg33_domain_score(spark, sf):
    score = F.greatest(*(F.col("__domains")[d] for d in V.DOMAINS))
    return V.prepared(_texts(spark, sf), "text", "keys").select("doc_id", V.domain().alias("category"), score.alias("score"))


@query(f"WITH {_TEXTS}, {_EMPHASIS} SELECT doc_id, dimension, score, round(weight, 6) AS weight FROM emphasis")
def agg34_dimension_emphasis(spark, sf):
    return V.emphasis(V.prepared(_texts(spark, sf), "text"), "doc_id")


@query(f"WITH {_TEXTS}, {_STYLES} SELECT doc_id, strict, moderate, lenient, style, CASE style WHEN 'strict' THEN 0.8::DOUBLE WHEN 'lenient' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS threshold FROM styles")
def agg35_evaluation_style(spark, sf):
    return V.prepared(_texts(spark, sf), "text").select("doc_id", "__styles.*", V.style().alias("style")).withColumn("threshold", V.threshold("style"))


@query(f"""WITH {_TEXTS}, {_DOMAINS}, {_EMPHASIS}, {_STYLES},
top AS (SELECT doc_id, first(dimension ORDER BY score DESC, i) AS top_emphasis FROM emphasis GROUP BY 1)
SELECT doc_id AS name, category, top_emphasis, style, CASE style WHEN 'strict' THEN 0.8::DOUBLE WHEN 'lenient' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS threshold, length(text)::BIGINT AS text_length, len(string_split(text, chr(10)))::BIGINT AS n_guidelines
FROM t JOIN domains USING (doc_id) JOIN top USING (doc_id) JOIN styles USING (doc_id)""")
def agg36_venue_profiles(spark, sf):
    return V.profiles(_texts(spark, sf), "doc_id", "text", "keys").drop("emphasis")


_NAMES = "asked AS (SELECT n_name AS name FROM nation UNION SELECT substr(n_name, 1, 3) FROM nation UNION SELECT 'The ' || n_name FROM nation UNION SELECT r_name FROM region)"


@query(f"""WITH {_NAMES}, hits AS (SELECT name, n_name AS profile, n_nationkey, upper(name) = n_name AS exact FROM asked JOIN nation ON contains(upper(name), n_name) OR contains(n_name, upper(name))),
best AS (SELECT name, first(profile ORDER BY exact DESC, n_nationkey) AS profile, max(exact) AS exact FROM hits GROUP BY 1)
SELECT name, profile, CASE WHEN exact THEN 'exact' WHEN profile IS NOT NULL THEN 'partial' ELSE 'default' END AS match FROM asked LEFT JOIN best USING (name)""")
def joi12_profile_lookup(spark, sf):
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    names = n.select(F.col("n_name").alias("name")).union(n.select(F.substring("n_name", 1, 3))).union(n.select(F.concat(F.lit("The "), "n_name"))).union(r.select("r_name"))
    return V.lookup(names, "name", n.select(F.col("n_name").alias("name"), "n_nationkey"), "n_nationkey")


_FULL = ", ".join(f"({i}, '{full}', '{short}')" for i, (full, short) in enumerate(V.SHORT_NAMES.items()))
_RAW = "[' 47th International Conference on Software Engineering', 'acm sigmod 2025', 'CHI ', ' Very Large Data Bases / ACM SIGMOD']"


@query(f"""WITH s(i, f, short) AS (VALUES {_FULL}), raw AS (SELECT c_custkey, list_extract({_RAW}, (c_custkey % 4 + 1)::INT) || c_mktsegment AS raw FROM customer)
SELECT c_custkey, coalesce((SELECT first(short ORDER BY i) FROM s WHERE contains(upper(raw), f)), trim(upper(raw))) AS name FROM raw""")
def prj21_venue_names(spark, sf):
    raw = F.array(*map(F.lit, (" 47th International Conference on Software Engineering", "acm sigmod 2025", "CHI ", " Very Large Data Bases / ACM SIGMOD")))
    c = D.table(spark, sf, "customer")
    return c.select("c_custkey", V.normal_name(F.concat(F.element_at(raw, (F.col("c_custkey") % 4 + 1).cast("int")), "c_mktsegment")).alias("name"))


@query(f"WITH {_TEXTS}, k AS (SELECT *, " + ", ".join(f"len(list_intersect(words, {list(w)})) > 0 AS f{i}" for i, w in enumerate(V.FOCUS.values())) + " FROM t) SELECT doc_id, CASE " + " ".join(f"WHEN f{i} THEN '{n}'" for i, n in enumerate(V.FOCUS)) + " ELSE 'general_compliance' END AS focus FROM k")
def prj24_focus(spark, sf):
    return _texts(spark, sf).select("doc_id", V.focus(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+")).alias("focus"))


_CONFIDENCE = """c AS (SELECT dimension, min(weight) / max(weight) AS consensus, greatest(0.0, 1 - stddev_pop(weight) / avg(weight)) AS cross_validation FROM weights GROUP BY 1),
o AS (SELECT dimension, 0.2 + consensus * 0.3 + 0.7 * 0.2 + 0.8 * 0.2 + round(cross_validation, 6) * 0.1 AS confidence FROM c)"""


@query(f"WITH {D.WEIGHTS_SQL}, {_CONFIDENCE} SELECT dimension, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS reliability FROM o")
def agg12_criteria_confidence(spark, sf):
    """Confidence of each dimension; the ratio of its least to its largest weight stands for the keyword consensus."""
    w = D.weights(spark, sf)
    consensus = w.groupBy("dimension").agg((F.min("weight") / F.max("weight")).alias("consensus"), F.count("*").alias("n"))
    rows = consensus.join(S.confidence(w, "dimension", "weight"), "dimension")
    found = rows.select("dimension", V.criteria_confidence(F.col("consensus"), F.col("score"), F.col("n")).alias("c"))
    return found.select("dimension", F.round("c", 6).alias("confidence"), V.reliability("c").alias("reliability"))


_CONSISTENT = "c AS (SELECT dimension, avg(weight) AS mean, stddev_pop(weight) AS std, first(venue ORDER BY weight, venue) AS least, first(venue ORDER BY weight DESC, venue) AS most FROM weights GROUP BY 1)"


@query(f"WITH {D.WEIGHTS_SQL}, {_CONSISTENT} SELECT dimension, round(mean, 6) AS mean, round(std, 6) AS std, least, most, CASE WHEN std > 0.1 THEN 'high' ELSE 'low' END AS level FROM c")
def agg09_dimension_consistency(spark, sf):
    return V.consistency(D.weights(spark, sf), "venue", "dimension", "weight")


_PAIRS = """s AS (SELECT p_brand AS seg, list_sort(list(DISTINCT p_type || ' ' || p_size)) AS words FROM part GROUP BY 1),
p AS (SELECT len(list_intersect(x.words, y.words))::DOUBLE / len(list_distinct(x.words || y.words)) AS ratio FROM s x JOIN s y ON x.seg < y.seg)"""


@query(f"""WITH {D.WEIGHTS_SQL}, skewed AS (SELECT venue, dimension, CASE WHEN dimension < 'C' AND venue < 'G' THEN weight * 3 ELSE weight END AS weight FROM weights), {_CONSISTENT.replace('FROM weights', 'FROM skewed')}, {_PAIRS}
SELECT 'High variance detected in ' || string_agg(dimension, ', ' ORDER BY dimension) || ' across conferences - consider conference-specific evaluation' AS recommendation FROM c WHERE std > 0.1 HAVING count(*) > 0
UNION ALL SELECT 'Low keyword overlap detected between some conference pairs - domain-specific criteria recommended' FROM p WHERE ratio < 0.3 HAVING count(*) > 0""")
def agg09_recommendations(spark, sf):
    """Weights of some venues are tripled, so that some dimensions vary."""
    far = (F.col("dimension") < "C") & (F.col("venue") < "G")
    w = D.weights(spark, sf).withColumn("weight", F.when(far, F.col("weight") * 3).otherwise(F.col("weight")))
    words = D.table(spark, sf, "part").select(F.col("p_brand").alias("seg"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("word"))
    return V.recommendations(V.consistency(w, "venue", "dimension", "weight"), "dimension", K.set_pairs(K.keyword_sets(words, "seg", "word"), "seg"), "jaccard")


@query("SELECT doc_id, coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '[aei]')))), 0)::BIGINT AS depth FROM documents")
def agg31_tree_depth(spark, sf):
    """Lines of a document as lines of a tree: its a, e and i drawn as box marks."""
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", V.tree_depth(F.split(F.translate("text", "aei", "│├└"), "\n")).alias("depth"))


@query("""WITH s AS (SELECT s_name AS name, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal / 10000 END AS score FROM supplier), k AS (SELECT DISTINCT s_name AS name FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal < 0)
SELECT count(*) AS n, round(avg(coalesce(score, 0)), 6) AS mean, first(name ORDER BY coalesce(score, 0) DESC, name) AS best, count_if(coalesce(score, 0) >= 0.8)::BIGINT AS high, count_if(coalesce(score, 0) >= 0.6 AND coalesce(score, 0) < 0.8)::BIGINT AS medium, count_if(coalesce(score, 0) < 0.6)::BIGINT AS low
FROM s JOIN k USING (name)""")
def agg32_named_comparison(spark, sf):
    """Suppliers as artifacts; named are those of a nation in which a customer owes money."""
    s = D.table(spark, sf, "supplier")
    named = s.join(D.table(spark, sf, "customer").filter("c_acctbal < 0").select("c_nationkey").distinct(), F.col("s_nationkey") == F.col("c_nationkey")).select(F.col("s_name").alias("name"))
    return V.comparison(s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal") / 10000).alias("score")), "name", "score", named)


_SENTENCES = "f AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'docs/INSTALL.md' ELSE 'docs/notes.md' END AS path, '# ' || replace(text, '. ', '.' || chr(10) || '# ') AS text FROM documents)"


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown files in which every sentence stands as a heading."""
    t = D.table(spark, sf, "documents")
    return t.select("doc_id", F.col("source").alias("artifact"), F.when(F.col("doc_id") % 7 == 0, "docs/INSTALL.md").otherwise("docs/notes.md").alias("path"), F.concat(F.lit("# "), F.replace("text", F.lit(". "), F.lit(".\n# "))).alias("text"))


_HEADINGS = f"""{_SENTENCES}, l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM f),
h AS (SELECT doc_id, lower(trim(regexp_replace(line, '^#+[ \\t\\r\\f\\v]*', ''))) AS heading FROM l WHERE line LIKE '#%'), c AS (SELECT heading, count(*) AS n, count(DISTINCT doc_id) AS files FROM h WHERE heading <> '' GROUP BY 1)"""


@query(f"WITH {_HEADINGS} SELECT heading, n, files FROM c")
def agg01_heading_counts(spark, sf):
    return V.heading_counts(_sentences(spark, sf), "doc_id", "text")


@query(f"WITH {_HEADINGS} SELECT heading, n FROM c ORDER BY n DESC, heading LIMIT 100")
def srt04_top_headings(spark, sf):
    return V.top_headings(V.heading_counts(_sentences(spark, sf), "doc_id", "text")).select("heading", "n")


def _any(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


@query(f"""WITH {_SENTENCES} SELECT source AS artifact, count(*) AS files, count_if(path = 'docs/INSTALL.md')::BIGINT AS named, count_if(coalesce(regexp_matches(text, '(?i)#+[ \\t\\n\\r\\f\\v]*(installation|setup|how to install|install)'), false))::BIGINT AS with_headings,
count_if(coalesce({_any(("installation", "setup"))}, false))::BIGINT AS with_text, count_if(coalesce({_any(V.DEPENDENCY_WORDS)}, false))::BIGINT AS with_dependencies, count_if(coalesce({_any(V.ENVIRONMENT_WORDS)}, false))::BIGINT AS with_environment FROM f GROUP BY 1""")
def fun12_installation_signs(spark, sf):
    return V.installation_signs(_sentences(spark, sf), "artifact", "path", "text")
