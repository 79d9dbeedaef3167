"""Queries of batch reports over artifacts dealt from ``documents``, each with its SQL: an artifact for each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as X
from ..operators import files_in_python as Y
from ..operators import mentions as W
from ..sources import readers as S
from . import artifact_graph as A
from . import batch_reports as B
from . import patterns as R
from . import profiles as Q
from . import readme_queries as U
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


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(artifact, path, size) of the paths that each document's artifact is dealt."""
    return D.dealt_paths(spark, sf).select(F.col("doc_id").alias("artifact"), "path", ((F.col("doc_id") * 31 + F.length("path") * 1700) % 500000).alias("size"))


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("artifact"))


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _holds(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_NAMED = [(k, [n.lower() for n in known if n[0] != "."]) for k, known in B.FILE_TYPES.items()]
_ENDS = [(k, [n for n in known if n[0] == "."]) for k, known in B.FILE_TYPES.items()]
_TYPE = "CASE " + " ".join(f"WHEN low IN ({_list(n)}) THEN '{k}'" for k, n in _NAMED if n) + " " + " ".join(f"WHEN x IN ({_list(n)}) THEN '{k}'" for k, n in _ENDS if n) + " ELSE 'other' END"
_LANGUAGE = "CASE x " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in B.LANGUAGES.items()) + " END"
_BUILD = "CASE " + " ".join(f"WHEN name IN ({_list(n)}) THEN '{k}'" for k, n in B.BUILD_SYSTEMS.items()) + " END"
_SQL = f"""
paths(i, path) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(D.MORE_PATHS))}),
n AS (SELECT doc_id AS artifact, path, (doc_id * 31 + length(path) * 1700) % 500000 AS size, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS low, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS x FROM documents, paths WHERE (doc_id * (i + 8) + i) % 97 < 16),
f AS (SELECT *, {_TYPE} AS type, {_LANGUAGE} AS language, {_BUILD} AS build FROM n),
c AS (SELECT *, CASE WHEN starts_with(low, 'readme') THEN 'readme' WHEN starts_with(low, 'license') OR low = 'copying' THEN 'license' WHEN low = 'dockerfile' THEN 'docker' WHEN contains(low, 'test') THEN 'test' ELSE '' END AS flag FROM f),
m AS (SELECT artifact, count(*) AS total_files, sum(size)::BIGINT AS total_size, count_if(type = 'code')::BIGINT AS code_files, count_if(type = 'documentation')::BIGINT AS documentation_files,
  coalesce(string_agg(DISTINCT CASE WHEN type = 'code' THEN language END, ',' ORDER BY CASE WHEN type = 'code' THEN language END), '') AS languages, coalesce(string_agg(DISTINCT build, ',' ORDER BY build), '') AS build_systems,
  bool_or(flag = 'readme') AS has_readme, bool_or(flag = 'license') AS has_license, bool_or(flag = 'docker') AS has_dockerfile, bool_or(flag = 'test') AS has_tests FROM c GROUP BY 1)"""


@query(f"WITH {_SQL} SELECT * FROM m")
def agg28_content_metadata(spark, sf):
    out = B.content_metadata(files(spark, sf))
    return out.withColumns({c: F.concat_ws(",", c) for c in ("languages", "build_systems")})


@query(f"WITH {_SQL} SELECT artifact, rank::INT AS rank, path, size FROM (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY size DESC, path) AS rank FROM f) WHERE rank <= 10")
def agg28_largest_files(spark, sf):
    return B.largest_files(files(spark, sf))


@query(f"WITH {_SQL} SELECT artifact, has_readme, has_license, has_dockerfile, has_tests, languages, build_systems FROM m")
def gq35_characteristics(spark, sf):
    return agg28_content_metadata(spark, sf).select("artifact", "has_readme", "has_license", "has_dockerfile", "has_tests", "languages", "build_systems")


@query(f"WITH {_SQL} SELECT x AS extension, count(*) AS file_count, count(DISTINCT artifact) AS artifact_count FROM f WHERE type = 'code' GROUP BY 1")
def gq34_language_files(spark, sf):
    return B.language_files(files(spark, sf))


@query(rf"""WITH {_SQL}, t AS (SELECT DISTINCT artifact, path, type, starts_with(low, 'test') OR ends_with(low, '_test.py') OR regexp_matches(lower(path), '(^|/)tests?/') AS test FROM f),
q AS (SELECT doc_id AS artifact, count_if(coalesce(type = 'documentation', false))::BIGINT AS doc_files, count(path) AS total_files, count_if(coalesce(test, false))::BIGINT AS test_files, count_if(coalesce(type = 'code', false))::BIGINT AS code_files FROM documents LEFT JOIN t ON doc_id = artifact GROUP BY 1)
SELECT *, CASE WHEN total_files > 0 THEN round(doc_files / total_files, 6) ELSE 0 END AS doc_ratio, CASE WHEN code_files > 0 THEN round(test_files / code_files, 6) ELSE 0 END AS test_ratio FROM q""")
def gq36_coverage(spark, sf):
    return B.coverage(artifacts(spark, sf), files(spark, sf))


@query(f"WITH {_SQL} SELECT count(*) AS artifacts, sum(total_files)::BIGINT AS total_files, round(sum(total_size) / 1048576.0, 2)::DOUBLE AS total_size_mb, round(avg(total_files), 1) AS files_per_artifact, round(sum(total_size) / 1048576.0 / count(*), 2)::DOUBLE AS mb_per_artifact FROM m")
def agg27_batch_totals(spark, sf):
    return B.batch_totals(B.content_metadata(files(spark, sf)))


@query(f"WITH {_SQL}, e AS (SELECT CASE WHEN x = '' THEN '(no extension)' ELSE x END AS extension, count(*) AS n FROM f GROUP BY 1) SELECT extension, n, (SELECT greatest(count(*) - 10, 0) FROM e) AS more FROM e ORDER BY n DESC, extension LIMIT 10")
def agg27_extension_distribution(spark, sf):
    return B.extension_distribution(files(spark, sf))


@query("SELECT doc_id AS artifact, f AS functions, c AS classes, f + c AS complexity_score FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 5 END AS f, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 3 END AS c FROM documents)")
def agg43_complexity_ranking(spark, sf):
    """Each artifact has a Python file of as many functions and classes as its id names; every seventh cannot be parsed."""
    d = F.col("doc_id")
    lines = lambda n, start, end: F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < n), lambda i: F.concat(F.lit(start), i.cast("string"), F.lit(end)))
    text = F.concat_ws("\n", lines(d % 5, "def f", "(): pass"), lines(d % 3, "class C", ": pass"), F.when(d % 7 == 0, "def ("))
    code = D.table(spark, sf, "documents").select(d.cast("string").alias("artifact"), F.lit("m.py").alias("path"), text.alias("text"))
    facts = Y.syntax_facts(code).withColumn("artifact", F.col("artifact").cast("long"))
    return B.complexity_ranking(artifacts(spark, sf), facts)


@query("""SELECT count(*) AS total, count_if(NOT ok)::BIGINT AS failed, round(count_if(a) / count(*), 6) AS extraction_success_rate, round(count_if(b) / count(*), 6) AS build_success_rate, round(count_if(ok) / count(*), 6) AS overall_success_rate,
round(sum(CASE WHEN s > 0 THEN s END), 6) AS total_seconds, round(avg(CASE WHEN s > 0 THEN s END), 6) AS average_seconds FROM (SELECT length(text) > 40 AND conv_id % 5 > 0 AS ok, length(text) > 40 AS a, conv_id % 5 > 0 AS b, ((length(text) - 60) / 8)::DOUBLE AS s FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations))""")
def agg26_batch_run(spark, sf):
    """Turns stand for the artifacts of a run: long ones are extracted, most are built, their length gives the seconds."""
    n = F.length(F.coalesce("text", F.lit("")))
    rows = D.table(spark, sf, "conversations").select((n > 40).alias("extracted"), (F.col("conv_id") % 5 > 0).alias("built"), ((n - 60) / 8).alias("seconds"))
    return B.run_statistics(rows.withColumn("success", F.col("extracted") & F.col("built")))


_FLAGS = ("has_readme", "has_docker", "has_zenodo_doi")
_LISTS = {"documentation_files": ("HAS_DOCUMENTATION", "Documentation"), "code_files": ("HAS_CODE", "CodeFile"), "data_files": ("HAS_DATA", "Dataset"), "docker_files": ("HAS_DOCKER", "DockerFile")}


@query(f"""WITH {O._SQL}, h AS (SELECT * FROM p WHERE probability > 0.4), k AS ({" UNION ALL ".join(f"SELECT '{x}' AS name FROM h WHERE {x}" for x in _FLAGS)} UNION ALL SELECT 'setup_complexity_' || setup_complexity FROM h),
l AS (SELECT artifact_name, 'HAS_DOCUMENTATION' AS type FROM h WHERE artifact_name::BIGINT % 3 = 0 OR artifact_name::BIGINT % 4 <> 0 UNION ALL SELECT artifact_name, 'HAS_CODE' FROM h WHERE artifact_name::BIGINT % 5 > 0 UNION ALL SELECT artifact_name, 'HAS_DATA' FROM h WHERE artifact_name::BIGINT % 3 = 2 UNION ALL SELECT artifact_name, 'HAS_DOCKER' FROM h WHERE artifact_name::BIGINT % 7 = 0),
z AS (SELECT count(*) AS n, round(avg(total_files), 6) AS a, round(median(total_files), 6)::DOUBLE AS b FROM h WHERE total_files > 0)
SELECT 'feature' AS kind, name, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM h), 6) AS value FROM k GROUP BY 2 UNION ALL SELECT 'relationship', type, count(*), NULL FROM l GROUP BY 2
UNION ALL SELECT 'average', 'mean_total_files', n, a FROM z WHERE n > 0 UNION ALL SELECT 'average', 'median_total_files', n, b FROM z WHERE n > 0""")
def agg42_high_score_characteristics(spark, sf):
    """Dealt artifacts have few strengths at once, so 0.4 is a high score here."""
    rows = O.artifacts(spark, sf)
    scored = R.predictions(O._scored(spark, sf)).withColumnRenamed("artifact_name", "artifact").withColumnRenamed("probability", "score")
    made = [rows.filter(F.size(c) > 0).select(F.col("artifact_name").alias("artifact"), F.lit(kind).alias("type"), F.lit(label).alias("label")) for c, (kind, label) in _LISTS.items()]
    links = made[0].union(made[1]).union(made[2]).union(made[3])
    return B.high_score_characteristics(scored, links, _FLAGS, ("setup_complexity",), 0.4)


_TOP = f"""WITH {U._SQL}, t AS (SELECT normalized AS section_type, count(DISTINCT artifact) AS artifacts, count(*) AS occurrences, round(avg(content_length), 6) AS mean_length, sum(has_code_snippet::INT + has_script_reference::INT + has_data_link::INT)::BIGINT AS actionable FROM m WHERE score > 0.7 GROUP BY 1 ORDER BY artifacts DESC, actionable DESC, section_type LIMIT 15)"""


@query(_TOP + " SELECT *, round(artifacts * 100 / max(artifacts) OVER (), 6) AS relative_importance, round(actionable * 100 / occurrences, 6) AS actionable_ratio FROM t")
def gq05_section_centrality(spark, sf):
    return B.section_centrality(U._rich(spark, sf), U._scores(spark, sf))


@query(f"WITH {U._SQL} SELECT heading AS setup_heading, count(DISTINCT artifact) AS artifact_count, round(count(DISTINCT artifact) * 100 / (SELECT count(DISTINCT artifact) FROM h), 6) AS prevalence FROM h WHERE {_holds('lower(heading)', B.SETUP_WORDS)} GROUP BY 1")
def gq08_setup_headings(spark, sf):
    return B.setup_headings(U.sections(spark, sf))


@query(f"WITH {U._SQL}, k AS (SELECT artifact, unnest(string_split(lower(body), ' ')) AS keyword FROM h) SELECT keyword, count(*) AS total_occurrences, count(DISTINCT artifact) AS artifacts_containing FROM k WHERE keyword IN ({_list(B.README_WORDS)}) GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 15")
def gq09_readme_words(spark, sf):
    return B.readme_words(U.sections(spark, sf))


_LANG = "CASE lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in P.LANGUAGES.items()) + " ELSE 'unknown' END"


@query(f"""WITH {D.MENTIONS_SQL}, s AS (SELECT doc_id, path, {_LANG} AS script_type FROM f WHERE {_holds('path', B.SCRIPT_PATHS)} OR {_LANG} IN ({_list(B.SCRIPT_LANGUAGES)})), q AS (SELECT script_type, doc_id, bool_or(target IS NOT NULL) AS named FROM s LEFT JOIN e ON e.artifact = s.doc_id AND e.target = s.path AND e.type = 'DESCRIBES' GROUP BY 1, 2)
SELECT script_type, count(*) AS artifacts_with_scripts, count_if(named)::BIGINT AS artifacts_mentioning_scripts, round(count_if(named) * 100 / count(*), 6) AS mention_rate FROM q GROUP BY 1""")
def gq12_script_mentions(spark, sf):
    all_ = D.artifact_files(spark, sf)
    links = W.edges(D.readmes(spark, sf), "artifact", "document", "text", all_, "path").filter("type = 'DESCRIBES'")
    return B.script_mentions(all_, links)


@query(f"WITH {D.MENTIONS_SQL}, q AS (SELECT doc_id, count_if({_holds('path', B.DATA_PATHS)}) AS n FROM f GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'no_data' WHEN n <= 5 THEN 'few_data_files' WHEN n <= 20 THEN 'moderate_data' ELSE 'data_heavy' END AS data_category, count(*) AS artifact_count FROM q GROUP BY 1")
def gq13_data_classes(spark, sf):
    return B.data_classes(D.artifact_files(spark, sf))


@query(f"""WITH {_SQL} SELECT CASE WHEN contains(lower(path), 'readme') THEN 'readme' WHEN contains(lower(path), 'license') THEN 'license' WHEN contains(lower(path), 'changelog') THEN 'changelog' WHEN contains(lower(path), 'api') OR contains(lower(path), 'reference') THEN 'api' ELSE 'general' END AS documentation,
CASE {" ".join(f"WHEN contains(lower(path), '{part}') THEN '{kind}'" for part, kind in P.DEPENDENCY_FILES.items())} ELSE 'unknown' END AS dependency, count(*) AS n FROM f GROUP BY 1, 2""")
def prj16_file_purposes(spark, sf):
    return files(spark, sf).groupBy(P.documentation_type("path").alias("documentation"), P.dependency_type("path").alias("dependency")).agg(F.count("*").alias("n"))


_WORD = lambda w: rf"(regexp_matches(readme, '\b({w})\b') OR regexp_matches(guide, '\b({w})\b'))"
_BATCH = "CASE WHEN has_data_files AND code_files = 0 THEN 'dataset' WHEN code_files > 0 AND has_examples THEN 'tool' WHEN has_docker OR has_setup_instructions THEN 'replication' ELSE 'unknown' END"


@query(f"""WITH {O._SQL}, y AS (SELECT doc_id::VARCHAR AS artifact_name, coalesce(readme, '') AS readme, coalesce(guide, '') AS guide FROM a)
SELECT artifact_name, CASE WHEN {_WORD('dataset|data|benchmark|corpus')} THEN 'dataset' WHEN {_WORD('replication|reproduction|replicate')} THEN 'replication' WHEN {_WORD('tool|framework|library|software')} THEN 'tool' WHEN code_files > 0 AND NOT has_data_files THEN 'software' WHEN has_data_files AND code_files = 0 THEN 'dataset' ELSE 'mixed' END AS type,
{_BATCH} AS batch_type FROM f JOIN y USING (artifact_name)""")
def prj16_artifact_types(spark, sf):
    rows = O.artifacts(spark, sf)
    text = F.array_join(F.transform("documentation_files", lambda f: F.array_join(f["content"], " ")), "\n")
    types = rows.select("artifact_name", B.artifact_type(text, F.size("code_files") > 0, F.size("data_files") > 0).alias("type"))
    c = F.col
    guessed = R.features(rows).select("artifact_name", B.batch_type(c("has_data_files"), c("code_files"), c("has_examples"), c("has_docker"), c("has_setup_instructions")).alias("batch_type"))
    return types.join(guessed, "artifact_name")


_KNOWN = {name: words[0] for name, words in Q.FOCUS.items()}
_SAID = f"list_extract([{_list((*_KNOWN.values(), 'unknown'))}], length(venue) % {len(_KNOWN) + 1} + 1)"


@query(f"""WITH {D.WEIGHTS_SQL}, t AS (SELECT venue, count(*) AS total_criteria, avg(weight) AS mean, stddev_pop(weight) AS std FROM weights GROUP BY 1)
SELECT venue, dimension, weight, 2 AS keyword_count, CASE {_SAID} {" ".join(f"WHEN '{word}' THEN '{name}'" for name, word in _KNOWN.items())} ELSE 'general_compliance' END AS focus, total_criteria,
round(mean + std, 6) AS high, round(mean, 6) AS medium, round(mean - std, 6) AS low, 0.1::DOUBLE AS minimum FROM weights JOIN t USING (venue)""")
def sco15_rubrics(spark, sf):
    """Nations as venues, the customers' segments as dimensions; keywords are the segment and a word by the length of the nation's name."""
    said = F.element_at(F.array(*map(F.lit, (*_KNOWN.values(), "unknown"))), F.length("venue") % (len(_KNOWN) + 1) + 1)
    return B.rubrics(D.weights(spark, sf).withColumn("keywords", F.array(F.lower("dimension"), said)), Q.focus("keywords"))


_DEEP = "g AS (SELECT artifact, CASE artifact % 3 WHEN 0 THEN 'node_modules/a/node_modules/' WHEN 1 THEN 'lib/node_modules/' ELSE '' END || path AS path FROM f)"


def _deep(spark: SparkSession, sf: str) -> DataFrame:
    """Some artifacts hold their files below module folders."""
    d = F.col("artifact") % 3
    above = F.when(d == 0, "node_modules/a/node_modules/").when(d == 1, "lib/node_modules/").otherwise("")
    return files(spark, sf).withColumn("path", F.concat(above, "path"))


@query(rf"WITH {_SQL} SELECT regexp_extract(name, '^.+(\.[^.]+)$', 1) AS extension, count(*) AS n FROM f WHERE regexp_matches(name, '^.+\.[^.]+$') GROUP BY 1")
def agg19_suffix_counts(spark, sf):
    return B.suffix_counts(files(spark, sf))


@query(f"WITH {_SQL}, q AS (SELECT doc_id AS artifact, count_if(coalesce(ends_with(path, '.md'), false))::BIGINT AS md_files FROM documents LEFT JOIN f ON doc_id = artifact GROUP BY 1) SELECT artifact, md_files, (SELECT sum(md_files)::BIGINT FROM q) AS total FROM q ORDER BY md_files DESC, artifact LIMIT 500")
def agg19_markdown_counts(spark, sf):
    return B.markdown_counts(artifacts(spark, sf), files(spark, sf))


@query(f"WITH {_SQL}, {_DEEP}, p AS (SELECT DISTINCT artifact, unnest(CASE artifact % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['c'] ELSE [] END) AS folder FROM g) SELECT count(*) AS folders FROM p")
def agg19_module_folders(spark, sf):
    return B.module_folders(_deep(spark, sf))


_CODE, _LICENSE = _list(P.CODE), "|".join(P.LICENSES)


@query(rf"""WITH {D.KINDS_SQL}, s AS (SELECT doc_id || '/' || path AS path, (doc_id * 31 + length(path) * 17) % 2600 * 1024 AS size, important, build OR config OR x = '.md' OR x IN ({_CODE}) OR regexp_matches(low, '{_LICENSE}') OR regexp_matches(path, '(^|/)(\.github|\.circleci|\.gitlab|\.idea|\.vscode)(/|$)') AS allowed, name FROM k),
r AS (SELECT path, size, CASE WHEN important THEN 'important' WHEN allowed THEN 'allowed' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1), CASE WHEN important THEN 'important' WHEN allowed THEN 'allowed' ELSE 'other' END ORDER BY name) AS place FROM s WHERE size <= 2048 * 1024)
SELECT path, size FROM r WHERE kind = 'important' OR kind = 'allowed' AND place <= 10 OR kind = 'other' AND place <= 3""")
def win01_sampled_by_folder(spark, sf):
    """The reader's choice of each folder's files: important ones, ten of known kinds, three others, none over 2 MB."""
    path = F.concat_ws("/", "doc_id", "path")
    size = (F.col("doc_id") * 31 + F.length("path") * 17) % 2600 * 1024
    return S.sampled(D.dealt_paths(spark, sf).select(path.alias("path"), size.alias("size")))


@query(f"SELECT doc_id, lower({D.SIGNAL_SQL}) AS heading FROM documents WHERE doc_id % 4 > 0")
def fun07_headings(spark, sf):
    """A phrase behind as many marks as the id names, and one line of marks alone, above lines of other kinds."""
    line = F.concat(F.lit("  "), F.repeat(F.lit("#"), (F.col("doc_id") % 4).cast("int")), F.lit(" "), D.signal_phrase(), F.lit("  "))
    text = F.concat_ws("\n", F.lit("##"), line, F.lit("no # heading"))
    return D.table(spark, sf, "documents").select("doc_id", F.explode(X.headings(text)).alias("heading"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (doc_id % 10)::DOUBLE WHEN 1 THEN NULL ELSE 5.0 END AS score, CASE doc_id % 4 WHEN 0 THEN 'fine' WHEN 1 THEN 'short' ELSE 'rule (not parsed)' END AS note FROM documents""")
def fun49_replies(spark, sf):
    """Replies in JSON, in JSON without a score, broken ones and none."""
    d = F.col("doc_id")
    whole = F.concat(F.lit(' {"score": '), d % 10, F.lit(', "note": "fine"} '))
    reply = F.when(d % 4 == 0, whole).when(d % 4 == 1, '{"note": "short"}').when(d % 4 == 2, "The score is {3")
    rule = F.struct(F.lit(5.0).alias("score"), F.lit("rule (not parsed)").alias("note"))
    got = B.parsed_reply(reply, "score double, note string", rule)
    return D.table(spark, sf, "documents").select("doc_id", got.alias("r")).select("doc_id", "r.score", "r.note")
