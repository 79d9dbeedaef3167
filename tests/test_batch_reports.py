"""Batch reports on small tables worked out by hand, with nulls, ties, repeats and empty tables."""

from pyspark.sql import functions as F

from strataforge.functions import files as P
from strataforge.plans import batch_reports as B

FILES = "artifact string, path string, size long"


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_file_types(spark):
    paths = {"src/a.py": "code", "b.JSON": "config", "c.xml": "data", "x/LICENSE": "license", "Makefile": "build", "makefile": "build", "docs/README.md": "documentation", "Dockerfile": "docker", "p.PNG": "image", "q.so": "binary", "r.mov": "video", "s": "other", "license.md": "license", "package.json": "build", ".py": "other", None: "other"}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", B.file_type("path").alias("type"))
    assert rows(got, "path", "type") == set(paths.items())


def test_content_metadata(spark):
    files = [("a", "README.md", 10), ("a", "src/m.py", 5), ("a", "src/m.js", None), ("a", "setup.py", 1), ("a", "requirements.txt", 1), ("b", "tests/readme_test.txt", 2), ("b", "LICENSE_test", 3), ("b", None, 4), ("c", "x/test_a.c", 0), ("c", "COPYING", 7), ("c", "dockerfile", 1)]
    got = {r["artifact"]: r for r in B.content_metadata(spark.createDataFrame(files, FILES)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["total_files"], a["total_size"], a["code_files"], a["documentation_files"]) == (5, 17, 2, 1)
    assert (a["languages"], a["build_systems"]) == (["JavaScript", "Python"], ["Python"])
    assert [a[k] for k in ("has_readme", "has_license", "has_dockerfile", "has_tests")] == [True, False, False, False]
    assert [b[k] for k in ("has_readme", "has_license", "has_dockerfile", "has_tests")] == [True, True, False, False]  # a name counts for its first flag only
    assert [c[k] for k in ("has_readme", "has_license", "has_dockerfile", "has_tests")] == [False, True, True, True]
    assert B.content_metadata(spark.createDataFrame([], FILES)).count() == 0


def test_largest_files(spark):
    files = spark.createDataFrame([("a", f"f{i}", i // 2) for i in range(6)] + [("a", "n", None), ("b", "x", 1), ("b", "x", 1)], FILES)
    got = [tuple(r) for r in B.largest_files(files, 3).orderBy("artifact", "rank").collect()]
    assert got == [("a", 1, "f4", 2), ("a", 2, "f5", 2), ("a", 3, "f2", 1), ("b", 1, "x", 1), ("b", 2, "x", 1)]


def test_hot_artifact_is_cut_before_the_shuffle(spark):
    plan = B.largest_files(spark.createDataFrame([("a", "x", 1)], FILES))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_languages_and_coverage(spark):
    files = spark.createDataFrame([("a", "m.py", 1), ("a", "m.py", 1), ("a", "tests/t.py", 1), ("b", "n.py", 1), ("b", "README.md", 1), ("b", None, 1)], FILES)
    assert rows(B.language_files(files), "extension", "file_count", "artifact_count") == {(".py", 4, 2)}
    artifacts = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "artifact string")
    got = rows(B.coverage(artifacts, files), "artifact", "doc_files", "total_files", "doc_ratio", "test_files", "code_files", "test_ratio")
    assert got == {("a", 0, 2, 0.0, 1, 2, 0.5), ("b", 1, 2, 0.5, 0, 1, 0.0), ("c", 0, 0, 0.0, 0, 0, 0.0)}


def test_totals_and_extensions(spark):
    files = spark.createDataFrame([("a", "x.py", 1048576), ("a", "y.PY", 0), ("b", "z", 524288), ("b", None, None)], FILES)
    assert tuple(B.batch_totals(B.content_metadata(files)).first()) == (2, 4, 1.5, 2.0, 0.75)
    assert [tuple(r) for r in B.extension_distribution(files, 1).collect()] == [("(no extension)", 2, 1)]


def test_runs(spark):
    kind = "success boolean, extracted boolean, built boolean, seconds double"
    got = B.run_statistics(spark.createDataFrame([(True, True, True, 4.0), (False, True, False, 0.0), (None, None, None, None), (True, True, True, 2.0)], kind)).first()
    assert tuple(got) == (4, 2, 0.75, 0.5, 0.5, 6.0, 3.0)
    assert tuple(B.run_statistics(spark.createDataFrame([], kind)).first()) == (0, 0, 0.0, 0.0, 0.0, None, None)


def test_complexity(spark):
    facts = spark.createDataFrame([("a", "m.py", "Function", "f", 1), ("a", "m.py", "Function", "f", 1), ("a", "m.py", "Function", "f", 9), ("a", "m.py", "Class", "C", 2), ("a", "m.py", "Import", "os", 3)], "artifact string, path string, kind string, name string, line int")
    got = B.complexity_ranking(spark.createDataFrame([("a",), ("b",)], "artifact string"), facts)
    assert rows(got, "artifact", "functions", "classes", "complexity_score") == {("a", 2, 1, 3), ("b", 0, 0, 0)}


def test_high_scores(spark):
    features = spark.createDataFrame([("a", 0.9, True, "low", 4), ("b", 0.8, False, "unknown", 0), ("c", 0.7, True, "low", 9), ("d", None, True, "low", 9)], "artifact string, score double, has_readme boolean, setup string, total_files int")
    links = spark.createDataFrame([("a", "HAS", "Code"), ("a", "HAS", "Code"), ("a", "HAS", "Data"), ("b", "HAS", "Code"), ("c", "HAS", "Code")], "artifact string, type string, label string")
    got = rows(B.high_score_characteristics(features, links, ("has_readme",), ("setup",)), "kind", "name", "n", "value")
    assert got == {("feature", "has_readme", 1, 50.0), ("feature", "setup_low", 1, 50.0), ("relationship", "HAS", 3, None), ("average", "mean_total_files", 1, 4.0), ("average", "median_total_files", 1, 4.0)}
    assert B.high_score_characteristics(features.filter("score > 1"), links, ("has_readme",), ("setup",)).count() == 0


def test_readme_links(spark):
    sections = spark.createDataFrame([("a", "Install", "Setup setup, docker"), ("a", "Run", "usage usage"), ("b", "install", None), ("b", "Other", "usage")], "artifact string, heading string, body string")
    assert rows(B.setup_headings(sections), "setup_heading", "artifact_count", "prevalence") == {("Install", 1, 50.0), ("Run", 1, 50.0), ("install", 1, 50.0)}
    assert {r["prevalence"] for r in B.setup_headings(sections, always_whole=True).collect()} == {100.0}
    assert [tuple(r) for r in B.readme_words(sections).collect()] == [("usage", 3, 2), ("docker", 1, 1), ("setup", 1, 1)]
    files = spark.createDataFrame([("a", "x.py"), ("a", "y.py"), ("b", "z.py"), ("b", "d.json"), ("c", "n.md")], "artifact string, path string")
    links = spark.createDataFrame([("a", "y.py"), ("a", "y.py"), ("b", "gone.py")], "artifact string, target string")
    assert rows(B.script_mentions(files, links), "script_type", "artifacts_with_scripts", "artifacts_mentioning_scripts", "mention_rate") == {("python", 2, 1, 50.0), ("unknown", 1, 0, 0.0)}
    assert rows(B.data_classes(files), "data_category", "artifact_count") == {("no_data", 2), ("few_data_files", 1)}


def test_section_centrality(spark):
    head = "artifact string, normalized string, content_length int, has_code_snippet boolean, has_script_reference boolean, has_data_link boolean"
    sections = spark.createDataFrame([("a", "usage", 10, True, True, False), ("a", "usage", 30, False, False, False), ("b", "usage", 20, False, False, True), ("a", "results", 5, False, False, False), ("c", "results", 9, True, True, True)], head)
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.71), ("c", 0.7)], "artifact string, score double")
    got = [tuple(r) for r in B.section_centrality(sections, scores).collect()]
    assert got == [("usage", 2, 3, 20.0, 3, 100.0, 100.0), ("results", 1, 1, 5.0, 0, 50.0, 0.0)]


def test_types_and_purposes(spark):
    t = spark.createDataFrame([("Our data set", True, True), ("metadata, a replication", True, False), ("a Tool", False, False), (None, True, False), ("", False, True), ("", True, True)], "doc string, code boolean, data boolean")
    assert [r[0] for r in t.select(B.artifact_type(F.col("doc"), F.col("code"), F.col("data"))).collect()] == ["dataset", "replication", "tool", "software", "dataset", "mixed"]
    p = spark.createDataFrame([("docs/README.md",), ("LICENSE",), ("changelog.md",), ("capital.md",), ("x.md",), ("requirements-dev.txt",)], "path string")
    assert [tuple(r) for r in p.select(P.documentation_type("path"), P.dependency_type("path")).collect()][:1] == [("readme", "unknown")]
    assert [r[0] for r in p.select(P.documentation_type("path")).collect()] == ["readme", "license", "changelog", "api", "general", "general"]


def test_rubrics(spark):
    c = spark.createDataFrame([("v", "x", 0.2, ["a", "b"]), ("v", "y", 0.6, None), ("w", "x", 1.0, [])], "venue string, dimension string, weight double, keywords array<string>")
    got = rows(B.rubrics(c, F.lit("f")), "venue", "dimension", "keyword_count", "total_criteria", "high", "medium", "low", "minimum")
    assert got == {("v", "x", 2, 2, 0.6, 0.4, 0.2, 0.1), ("v", "y", 0, 2, 0.6, 0.4, 0.2, 0.1), ("w", "x", 0, 1, 1.0, 1.0, 1.0, 0.1)}


def test_headings_with_blanks_and_digits(spark):
    from strataforge.functions import text as X

    t = spark.createDataFrame([("##\n  # FAQ  \nno # heading\n3 # no\n### 4 Steps 4",), (None,), ("",)], "text string")
    assert [r[0] for r in t.select(X.headings("text")).collect()] == [["faq", "4 steps 4"], None, []]


def test_suffixes_markdown_and_folders(spark):
    files = spark.createDataFrame([("a", "x.MD", 1), ("a", "y.md", 1), ("a", "node_modules/p/node_modules/q.js", 1), ("a", "node_modules/r", 1), ("b", "node_modules", 1), ("b", ".md", 1), ("b", None, 1)], FILES)
    assert rows(B.suffix_counts(files), "extension", "n") == {(".MD", 1), (".md", 1), (".js", 1)}
    artifacts = spark.createDataFrame([("a",), ("b",), ("c",)], "artifact string")
    assert [tuple(r) for r in B.markdown_counts(artifacts, files).collect()] == [("a", 1, 2), ("b", 1, 2), ("c", 0, 2)]
    assert B.module_folders(files).first()["folders"] == 2
    assert [tuple(r) for r in B.markdown_counts(artifacts, files.limit(0), 1).collect()] == [("a", 0, 0)]


def test_replies(spark):
    rule = F.struct(F.lit(5.0).alias("score"), F.lit("rule").alias("note"))
    t = spark.createDataFrame([('{"score": 1, "note": "n", "more": [1]}',), (' {"note": "n"}\n',), ("{",), ("[1]",), ("7",), (None,), ("",)], "reply string")
    got = [tuple(r[0]) for r in t.select(B.parsed_reply("reply", "score double, note string", rule)).collect()]
    assert got == [(1.0, "n"), (None, "n")] + [(5.0, "rule")] * 5


def test_score_patterns(spark):
    from strataforge.plans import graph_reports as H

    a = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", None)], "id string, score double")
    e = spark.createDataFrame([("a", "HAS", "x"), ("a", "HAS", "y"), ("b", "HAS", "x"), ("c", "HAS", "x"), ("a", "USES", "gone")], "src string, type string, dst string")
    n = spark.createDataFrame([("x", "Code"), ("y", "Code")], "id string, label string")
    assert [tuple(r) for r in H.score_patterns(a, e, n).collect()] == [("HAS", "Code", 3, 0.766667)]
    assert [tuple(r) for r in H.score_patterns(a, e, n, 0.7).collect()] == [("HAS", "Code", 2, 0.9)]


def test_requirements_keep_their_digits(spark):
    from strataforge.functions import text as X

    t = spark.createDataFrame([("0x\n  numpy==1.1  \n# no\npandas>=2",)], "text string")
    got = [(r["name"]) for r in t.select(F.explode(X.requirements("text")).alias("d")).select("d.*").collect()]
    assert got == ["0x", "numpy", "pandas"]
    assert "1.1" in str(t.select(X.requirements("text")).first()[0])


def test_high_scores_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(k):
        seen.add(1)
        return k / 10

    rows = spark.range(10).select(F.col("id").cast("string").alias("artifact"), score("id").alias("score"), F.lit(True).alias("has_readme"), F.lit("low").alias("setup"), F.col("id").alias("total_files"))
    links = spark.createDataFrame([("9", "HAS_CODE", "CodeFile")], "artifact string, type string, label string")
    got = {(r["kind"], r["name"]): (r["n"], r["value"]) for r in B.high_score_characteristics(rows, links, ("has_readme",), ("setup",), 0.65).collect()}
    assert got == {("feature", "has_readme"): (3, 100.0), ("feature", "setup_low"): (3, 100.0), ("relationship", "HAS_CODE"): (1, None), ("average", "mean_total_files"): (3, 8.0), ("average", "median_total_files"): (3, 8.0)}
    assert seen.value <= 20  # once for the filter, once for the column
