"""Reports over a batch of artifacts: what they hold, languages, coverage, rankings, runs, README links, high scores.

``files`` has (artifact, path, size), one row a file.  Sums are taken by (artifact, key) first and then by key, so an
artifact or key that holds a third of all rows is added up before it is shuffled.  No report collects file
or artifact names into one row; where names are wanted they are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as P
from ..operators.tables import kept
from . import graph_reports as H

# File types by name or extension; names are looked up before extensions, types in this order.
FILE_TYPES = {
    "code": (".py", ".java", ".cpp", ".c", ".h", ".js", ".ts", ".go", ".rs", ".rb", ".php", ".cs", ".kt"),
    "documentation": (".md", ".rst", ".txt", ".doc", ".docx", ".pdf"),
    "config": (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf"),
    "data": (".csv", ".json", ".xml", ".sql", ".db", ".sqlite"),
    "build": ("Makefile", "CMakeLists.txt", "build.gradle", "pom.xml", "package.json", "requirements.txt", "setup.py"),
    "docker": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml"),
    "license": ("LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING"),
    "binary": (".exe", ".dll", ".so", ".dylib"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".svg"),
    "video": (".mp4", ".avi", ".mov"),
}
# Languages of code files by extension.
LANGUAGES = {".py": "Python", ".java": "Java", ".cpp": "C++", ".c": "C", ".h": "C/C++", ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".kt": "Kotlin"}
# Build systems by exact file name.
BUILD_SYSTEMS = {"Python": ("setup.py", "pyproject.toml", "requirements.txt"), "Node.js": ("package.json", "yarn.lock"), "Java": ("pom.xml", "build.gradle"), "C/C++": ("Makefile", "CMakeLists.txt")}
# README words that are counted, scripts by language and path, data files by path, words of setup headings.
README_WORDS = ("installation", "setup", "usage", "example", "docker", "requirements", "dependencies", "citation", "license", "contribute", "overview", "description", "running", "scripts")
SCRIPT_LANGUAGES, SCRIPT_PATHS = ("shell", "bash", "python", "javascript"), (".sh", ".py", ".js")
DATA_PATHS = (".csv", ".json", ".xml", ".txt", "data")
SETUP_WORDS = ("install", "setup", "usage", "run")


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def _held(x: Column | str, parts: tuple[str, ...]) -> Column:
    """Whether ``x`` holds one of ``parts`` as written."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(F.col(x) if isinstance(x, str) else x, F.lit(part))
    return out


def _table(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def file_type(path: Column | str) -> Column:
    """The type of a file by its whole name, else by its extension; ``other`` if neither is known."""
    low, ext = F.lower(P.name(path)), P.extension(path)
    names = (F.when(low.isin(*(n.lower() for n in known if n[0] != ".")), kind) for kind, known in FILE_TYPES.items() if any(n[0] != "." for n in known))
    ends = (F.when(ext.isin(*(n for n in known if n[0] == ".")), kind) for kind, known in FILE_TYPES.items() if any(n[0] == "." for n in known))
    return F.coalesce(*names, *ends, F.lit("other"))


def build_system(path: Column | str) -> Column:
    return _table({n: system for system, known in BUILD_SYSTEMS.items() for n in known}, P.name(path))


def content_metadata(files: DataFrame) -> DataFrame:
    """(artifact, total_files, total_size, code_files, documentation_files, languages, build_systems, has_readme, has_license, has_dockerfile, has_tests).

    A file counts for the first flag that fits its name.  Null sizes count as 0; a null path is a file of type other.
    Languages and build systems are sorted arrays of at most as many names as their tables have.
    """
    low, kind = F.coalesce(F.lower(P.name("path")), F.lit("")), file_type("path")
    readme, license_, docker = low.startswith("readme"), low.startswith("license") | (low == "copying"), low == "dockerfile"
    some = lambda test: F.bool_or(test)
    return files.groupBy("artifact").agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.count_if(kind == "code").alias("code_files"), F.count_if(kind == "documentation").alias("documentation_files"),
        F.sort_array(F.collect_set(F.when(kind == "code", _table(LANGUAGES, P.extension("path"))))).alias("languages"), F.sort_array(F.collect_set(build_system("path"))).alias("build_systems"),
        some(readme).alias("has_readme"), some(~readme & license_).alias("has_license"), some(~readme & ~license_ & docker).alias("has_dockerfile"),
        some(~readme & ~license_ & ~docker & F.contains(low, F.lit("test"))).alias("has_tests"),
    )


def largest_files(files: DataFrame, k: int = 10) -> DataFrame:
    """(artifact, rank, path, size): each artifact's ``k`` largest files, ties in order of path.  Spark keeps ``k`` rows an artifact and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("artifact").orderBy(F.desc_nulls_last("size"), "path"))
    return files.withColumn("rank", rank).filter(F.col("rank") <= k).select("artifact", "rank", "path", "size")


def language_artifacts(files: DataFrame) -> DataFrame:
    """(extension, artifact, files) of code files."""
    return files.filter(file_type("path") == "code").groupBy(P.extension("path").alias("extension"), "artifact").agg(F.count("*").alias("files"))


def language_files(files: DataFrame) -> DataFrame:
    """(extension, file_count, artifact_count) of code files; ``language_artifacts`` names the artifacts."""
    return language_artifacts(files).groupBy("extension").agg(F.sum("files").alias("file_count"), F.count("*").alias("artifact_count"))


def coverage(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(artifact, doc_files, total_files, doc_ratio, test_files, code_files, test_ratio) of every artifact.

    A path counts once.  Ratios are 0 where there is nothing to divide by.
    """
    kind = file_type("path")
    per = files.select("artifact", "path").distinct().groupBy("artifact").agg(
        F.count_if(kind == "documentation").alias("doc_files"), F.count("path").alias("total_files"), F.count_if(P.is_test("path")).alias("test_files"), F.count_if(kind == "code").alias("code_files")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ratio = lambda a, b: _r(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    rows = artifacts.select("artifact").distinct().join(per, "artifact", "left").select("artifact", n("doc_files"), n("total_files"), n("test_files"), n("code_files"))
    return rows.withColumns({"doc_ratio": ratio("doc_files", "total_files"), "test_ratio": ratio("test_files", "code_files")})


def batch_totals(metadata: DataFrame) -> DataFrame:
    """One row (artifacts, total_files, total_size_mb, files_per_artifact, mb_per_artifact) from ``content_metadata``."""
    mb = F.sum("total_size") / 1048576
    return metadata.agg(
        F.count("*").alias("artifacts"), F.sum("total_files").alias("total_files"), _r(mb, 2).alias("total_size_mb"), _r(F.avg("total_files"), 1).alias("files_per_artifact"), _r(mb / F.count("*"), 2).alias("mb_per_artifact")
    )


def extension_distribution(files: DataFrame, k: int = 10) -> DataFrame:
    """(extension, n, more): the ``k`` most common extensions, and how many kinds the report leaves out."""
    counts = files.groupBy(F.coalesce(F.nullif(P.extension("path"), F.lit("")), F.lit("(no extension)")).alias("extension")).agg(F.count("*").alias("n"))
    kinds = counts.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return counts.orderBy(F.desc("n"), "extension").limit(k).join(F.broadcast(kinds))  # one row


def complexity_ranking(artifacts: DataFrame, facts: DataFrame) -> DataFrame:
    """(artifact, functions, classes, complexity_score) of every artifact from (artifact, path, kind, name, line) facts; a definition counts once."""
    per = facts.filter("kind in ('Function', 'Class')").select("artifact", "path", "kind", "name", "line").distinct()
    per = per.groupBy("artifact").agg(F.count_if(F.col("kind") == "Function").alias("functions"), F.count_if(F.col("kind") == "Class").alias("classes"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = artifacts.select("artifact").distinct().join(per, "artifact", "left").select("artifact", n("functions"), n("classes"))
    return rows.withColumn("complexity_score", F.col("functions") + F.col("classes"))


def run_statistics(results: DataFrame) -> DataFrame:
    """One row of a batch run from (success, extracted, built, seconds): counts, rates, and times over positive ones only; an empty run has rates of 0 and null times."""
    n = F.count("*")
    rate = lambda c: _r(F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0)))
    spent = F.when(F.col("seconds") > 0, F.col("seconds"))
    return results.agg(
        n.alias("total"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), rate("extracted").alias("extraction_success_rate"), rate("built").alias("build_success_rate"), rate("success").alias("overall_success_rate"),
        _r(F.sum(spent)).alias("total_seconds"), _r(F.avg(spent)).alias("average_seconds"),
    )


def high_score_characteristics(features: DataFrame, links: DataFrame, flags: tuple[str, ...], classes: tuple[str, ...], least: float = H.HIGH) -> DataFrame:
    """(kind, name, n, value) of artifacts whose score is over ``least``.

    ``feature``: how many have a flag, or a class (``name_value``; unknown is left out), and their percentage.
    ``relationship``: pairs of artifact and target label that a type of link joins.  ``average``: mean and median of positive total_files.
    """
    high = kept(features.select("artifact", "score", "total_files", *flags, *classes).filter(F.col("score") > least), "high")  # features cost much and are read five times
    named = [F.when(F.col(f), F.lit(f)) for f in flags] + [F.when(F.col(c) != "unknown", F.concat(F.lit(f"{c}_"), c)) for c in classes]
    total = high.agg(F.count("*").alias("all"))
    common = high.select(F.explode(F.array_compact(F.array(*named))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row
    common = common.select(F.lit("feature").alias("kind"), "name", "n", _r(F.col("n") * 100 / F.col("all")).alias("value"))
    joined = links.select("artifact", "type", "label").distinct().join(high.select("artifact"), "artifact", "left_semi")
    related = joined.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("relationship"), "type", "n", F.lit(None).cast("double"))
    sized = high.filter("total_files > 0").agg(F.count("*").alias("n"), _r(F.avg("total_files")).alias("mean"), _r(F.median("total_files")).alias("median")).filter("n > 0")
    averages = sized.select(F.lit("average"), F.explode(F.create_map(F.lit("mean_total_files"), "mean", F.lit("median_total_files"), "median")).alias("name", "value"), "n").select("average", "name", "n", "value")
    return common.union(related).union(averages)


def section_centrality(sections: DataFrame, scores: DataFrame, least: float = H.HIGH, k: int = 15) -> DataFrame:
    """(section_type, artifacts, occurrences, mean_length, actionable, relative_importance, actionable_ratio): the ``k`` section types of most high-scoring artifacts.

    ``sections`` are enriched ones.  Importance is relative to the first type; the ratio is code, script and data signs per 100 sections.
    """
    high = scores.filter(F.col("score") > least).select("artifact").distinct()
    signs = sum((F.count_if(c) for c in ("has_script_reference", "has_data_link")), F.count_if("has_code_snippet"))
    per = sections.join(high, "artifact", "left_semi").groupBy(F.col("normalized").alias("section_type"), "artifact").agg(F.count("*").alias("n"), F.sum("content_length").alias("length"), signs.alias("signs"))
    ranked = per.groupBy("section_type").agg(F.count("*").alias("artifacts"), F.sum("n").alias("occurrences"), _r(F.sum("length") / F.sum("n")).alias("mean_length"), F.sum("signs").alias("actionable"))
    top = ranked.orderBy(F.desc("artifacts"), F.desc("actionable"), "section_type").limit(k)
    most = F.max("artifacts").over(Window.partitionBy())  # at most k rows
    return top.select("*", _r(F.col("artifacts") * 100 / most).alias("relative_importance"), _r(F.col("actionable") * 100 / F.col("occurrences")).alias("actionable_ratio"))


def setup_headings(sections: DataFrame, always_whole: bool = False) -> DataFrame:
    """(setup_heading, artifact_count, prevalence): headings that say install, setup, usage or run, with the percentage of artifacts with sections.

    ``always_whole`` gives 100 throughout, as a division of each count by itself does.
    """
    all_ = sections.select("artifact").distinct().agg(F.count("*").alias("all"))
    rows = sections.filter(_held(F.lower("heading"), SETUP_WORDS)).select(F.col("heading").alias("setup_heading"), "artifact").distinct()
    counted = rows.groupBy("setup_heading").agg(F.count("*").alias("artifact_count")).join(F.broadcast(all_))  # one row
    return counted.select("setup_heading", "artifact_count", F.lit(100.0).alias("prevalence") if always_whole else _r(F.col("artifact_count") * 100 / F.col("all")).alias("prevalence"))


def readme_words(sections: DataFrame, k: int = 15) -> DataFrame:
    """(keyword, total_occurrences, artifacts_containing): listed words between spaces of section texts; most artifacts first."""
    words = sections.select("artifact", F.explode(F.split(F.lower("body"), " ")).alias("keyword")).filter(F.col("keyword").isin(*README_WORDS))
    counted = words.groupBy("keyword", "artifact").agg(F.count("*").alias("n")).groupBy("keyword").agg(F.sum("n").alias("total_occurrences"), F.count("*").alias("artifacts_containing"))
    return counted.orderBy(F.desc("artifacts_containing"), F.desc("total_occurrences"), "keyword").limit(k)


def script_mentions(files: DataFrame, links: DataFrame) -> DataFrame:
    """(script_type, artifacts_with_scripts, artifacts_mentioning_scripts, mention_rate) by language.

    ``links`` are (artifact, target) of files that the artifact's README names; ``files`` are those of artifacts with a README.
    """
    language = P.language("path")
    scripts = files.select("artifact", "path", language.alias("script_type")).filter(language.isin(*SCRIPT_LANGUAGES) | _held("path", SCRIPT_PATHS))
    named = links.select("artifact", F.col("target").alias("path"), F.lit(True).alias("named")).distinct()
    per = scripts.join(named, ["artifact", "path"], "left").groupBy("script_type", "artifact").agg(F.coalesce(F.bool_or("named"), F.lit(False)).alias("named"))
    out = per.groupBy("script_type").agg(F.count("*").alias("artifacts_with_scripts"), F.count_if("named").alias("artifacts_mentioning_scripts"))
    return out.withColumn("mention_rate", _r(F.col("artifacts_mentioning_scripts") * 100 / F.col("artifacts_with_scripts")))


def data_classes(files: DataFrame) -> DataFrame:
    """(data_category, artifact_count): artifacts by how many files their paths show to be data; artifacts without files are no row of ``files`` and do not count."""
    per = files.groupBy("artifact").agg(F.count_if(_held("path", DATA_PATHS)).alias("n"))
    kind = F.when(F.col("n") == 0, "no_data").when(F.col("n") <= 5, "few_data_files").when(F.col("n") <= 20, "moderate_data").otherwise("data_heavy")
    return per.groupBy(kind.alias("data_category")).agg(F.count("*").alias("artifact_count"))


def artifact_type(documents: Column, has_code: Column, has_data: Column) -> Column:
    """What an artifact is, by whole words of all its documentation (null: none), else by its code and data."""
    low = F.lower(F.coalesce(documents, F.lit("")))
    word = lambda words: low.rlike(rf"\b({words})\b")
    return (
        F.when(word("dataset|data|benchmark|corpus"), "dataset").when(word("replication|reproduction|replicate"), "replication").when(word("tool|framework|library|software"), "tool")
        .when(has_code & ~has_data, "software").when(has_data & ~has_code, "dataset").otherwise("mixed")
    )


def batch_type(has_data_files: Column, code_files: Column, has_examples: Column, has_docker: Column, has_setup: Column) -> Column:
    """The same from features alone, as batch summaries tell it."""
    return F.when(has_data_files & (code_files == 0), "dataset").when((code_files > 0) & has_examples, "tool").when(has_docker | has_setup, "replication").otherwise("unknown")


def rubrics(criteria: DataFrame, focus: Column) -> DataFrame:
    """A venue's rubric, a row a dimension: weight, keyword_count, focus, total_criteria, and the venue's thresholds high, medium, low and minimum.

    ``criteria`` has (venue, dimension, weight, keywords).  Thresholds are the mean weight of the venue plus, without and
    minus one population standard deviation; 0.1 is the least acceptable.  Null keywords count as none.
    """
    per = criteria.groupBy("venue").agg(F.count("*").alias("total_criteria"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"))
    rows = criteria.join(per, "venue")
    mean, std = F.col("mean"), F.col("std")
    return rows.select(
        "venue", "dimension", "weight", F.coalesce(F.size("keywords"), F.lit(0)).alias("keyword_count"), focus.alias("focus"), "total_criteria",
        _r(mean + std).alias("high"), _r(mean).alias("medium"), _r(mean - std).alias("low"), F.lit(0.1).alias("minimum"),
    )


def suffix_counts(files: DataFrame) -> DataFrame:
    """(extension, n) as written, case kept; files without one are left out."""
    return files.select(F.regexp_extract(P.name("path"), r"^.+(\.[^.]+)$", 1).alias("extension")).filter("extension <> ''").groupBy("extension").agg(F.count("*").alias("n"))


def markdown_counts(artifacts: DataFrame, files: DataFrame, k: int = 500) -> DataFrame:
    """(artifact, md_files, total): the ``k`` artifacts of most ``.md`` files, those without any last, and the total of all artifacts."""
    per = files.filter(F.endswith("path", F.lit(".md"))).groupBy("artifact").agg(F.count("*").alias("md_files"))
    every = artifacts.select("artifact").distinct().join(per, "artifact", "left").select("artifact", F.coalesce("md_files", F.lit(0)).alias("md_files"))
    total = per.agg(F.coalesce(F.sum("md_files"), F.lit(0)).alias("total"))
    return every.orderBy(F.desc("md_files"), "artifact").limit(k).join(F.broadcast(total))  # one row


def module_folders(files: DataFrame, name: str = "node_modules") -> DataFrame:
    """One row: how many folders of a name the artifacts hold, nested ones too."""
    parts = F.split(P.parent("path"), "/")
    at = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.element_at(parts, i) == name)
    folders = files.select("artifact", F.explode(F.transform(at, lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))).alias("folder")).distinct()
    return folders.agg(F.count("*").alias("folders"))


def parsed_reply(reply: Column | str, schema: str, fallback: Column) -> Column:
    """A model's reply as a struct of ``schema``; ``fallback`` where it is null or no JSON object."""
    text = F.trim(F.col(reply) if isinstance(reply, str) else reply)
    return F.coalesce(F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, schema)), fallback)
