import random
import re
import time

from strataforge.plans import agents as A


def artifact(name, **k):
    base = dict.fromkeys([f.name for f in A.ARTIFACT.fields])
    return tuple((base | {"artifact_name": name} | k)[f.name] for f in A.ARTIFACT.fields)


FULL = dict(
    repository_name="x",
    repository_url="https://zenodo.org/1",
    repository_structure=[(n, p, None, 1.0) for n, p in (("README.md", "README.md"), ("setup.py", "setup.py"), ("main.py", "src/main.py"), ("test_a.py", "tests/test_a.py"), ("Dockerfile", "Dockerfile"), ("requirements.txt", "requirements.txt"), ("a.csv", "data/a.csv"))],
    documentation_files=[("README.md", ["# Overview", "Install with pip install x", "Usage: run main.py", "```", "doi.org/10.1/2", "MIT license"])],
    license_files=[("LICENSE", ["MIT License"])],
    code_files=[("src/main.py", ["import os", "try:", "  x()", "except:", "  raise Error"])],
)


def test_scores_are_capped_and_ordered(spark):
    df = spark.createDataFrame([artifact("full", **FULL), artifact("empty"), artifact("failed", success=False)], A.ARTIFACT)
    parts = {(r["artifact_name"], r["component"]): r["score"] for r in A.component_scores(df).collect()}
    assert all(0 <= v <= 1 for v in parts.values()) and len({c for _, c in parts}) == 23
    assert parts["full", "availability"] == 1.0 and parts["full", "licensing"] == 1.0 and parts["full", "archival"] == 1.0
    assert parts["empty", "availability"] == 0.0 and parts["empty", "readme"] == 0.0 and parts["empty", "archival"] == 0.3
    total = {r["artifact_name"]: r for r in A.evaluate(df).collect()}
    assert set(total) == {"full", "empty"} and total["full"]["total"] > total["empty"]["total"]
    assert not total["empty"]["accepted"] and "usability" in total["empty"]["weaknesses"]


def test_reviews_only_raise(spark):
    scores = spark.createDataFrame([("a", "usability", 0.4, ["x"], "fair usability")], "artifact_name string, dimension string, score double, evidence array<string>, justification string")
    up = spark.createDataFrame([("a", "usability", 0.9, "good")], "artifact_name string, dimension string, review double, comment string")
    down = spark.createDataFrame([("a", "usability", 0.1, "bad")], "artifact_name string, dimension string, review double, comment string")
    assert A.reviewed(scores, up).first()["score"] == 0.9
    assert A.reviewed(scores, down).first()["score"] == 0.4


def held(spark, **k):
    row = A.texts(spark.createDataFrame([artifact("x", **k)], A.ARTIFACT)).select(*[v.alias(n) for n, v in A.flags().items()]).first()
    return {n for n, v in row.asDict().items() if v}


def entries(*paths):
    return [(p.rpartition("/")[2], p, None, 1.0) for p in paths]


def test_hosts(spark):
    hosts = {"archive_host", "code_host", "other_host"}
    for url, kind in (("https://dataverse.org/x", "archive_host"), ("https://archive.org/x", "other_host"), ("https://github.com/zenodo", "archive_host"), ("https://gitlab.com/x", "code_host"), ("https://github.io/x", "other_host")):
        assert held(spark, repository_url=url) & hosts == {kind}


def test_file_flags(spark):
    assert "config_files" not in held(spark, repository_structure=entries("a.yml", "b.json"))
    assert "config_files" in held(spark, repository_structure=entries("environment.txt"))
    assert "setup_files" in held(spark, repository_structure=entries("Dockerfile"))
    assert "PRE12" in held(spark, repository_structure=entries("app.py"))
    assert "PRE30" not in held(spark, repository_structure=entries("a.py.bak")) and "PRE30" in held(spark, repository_structure=entries("a.tar.gz"))
    tests = held(spark, repository_structure=entries("tests/a.py"))
    assert "PRE38" in tests and "PRE25" not in tests
    assert "PRE48" in held(spark, code_files=[(f"f{i}.py", ["x"]) for i in range(4)]) and "PRE48" not in held(spark, code_files=[("f.py", ["module"])])
    assert "PRE32" in held(spark, documentation_files=[("a.md", ["see the changelog"])])
    found = held(spark, documentation_files=[("README.md", ["About", "see the paper"])])
    assert {"purpose", "provenance"} <= found and not found & {"setup_section", "usage_section"}


def test_tier_needs_every_component(spark):
    rows = [("a", "documentation", c, v, []) for c, v in (("readme", 1.0), ("setup_instructions", 0.9), ("usage_instructions", 0.5), ("comprehensive", 0.0))]
    out = A.agent_scores(spark.createDataFrame(rows, "artifact_name string, dimension string, component string, score double, evidence array<string>")).first()
    assert out["justification"] == "fair documentation" and out["score"] == 0.6


def test_flags_read_the_files_that_the_rules_name(spark):
    two = [("guide.md", ["GPU"]), ("README.md", []), ("docs/readme.txt", ["Install", "License"])]
    found = held(spark, documentation_files=two)
    assert {"has_readme", "PRE04", "PRE08", "PRE18", "PRE31"} <= found and not found & {"setup_section", "PRE06"}
    assert "PRE04" not in held(spark, documentation_files=[("guide.md", ["license"])])
    assert "PRE02" in held(spark, repository_url="https://doi.org/1") and "PRE02" not in held(spark, documentation_files=[("a.md", ["DOI.ORG"])])
    assert "PRE23" in held(spark, documentation_files=[("a.md", ["http://x"])]) and "PRE23" in held(spark, documentation_files=[("a.md", ["Dataset"])])
    assert "PRE21" in held(spark, repository_structure=entries("metadata/a.bin")) and "PRE21" not in held(spark, repository_structure=entries("datasets/a.bin"))
    assert "PRE39" not in held(spark, repository_structure=entries("validator.py")) and "example_files" in held(spark, repository_structure=entries("tutorial.md"))
    assert "PRE33" not in held(spark, code_files=[("a.py", ["Import os"])]) and "PRE59" not in held(spark, documentation_files=[("a.md", ["Python x.py"])])
    assert "PRE50" not in held(spark, code_files=[("a.py", ["def f("]), ("b.py", [")"])]) and "PRE50" in held(spark, code_files=[("a.py", ["def f(", ")"])])


def test_sums_are_not_rounded_before_the_tiers(spark):
    rows = [artifact("x", repository_structure=entries("gui.js", "cli.md", "notebook.md", "mobile.md"))]
    got = A.component(spark.createDataFrame(rows, A.ARTIFACT), "usability", "user_interface").first()["score"]
    assert got == 0.3 + 0.2 + 0.2 + 0.2 + 0.1
    rows = [artifact("y", repository_structure=entries("a.js", "cli.md", "gui.md", "mobile.md"))]
    got = A.component(spark.createDataFrame(rows, A.ARTIFACT), "usability", "user_interface").first()["score"]
    assert got == 0.3 + 0.2 + 0.2 + 0.1 and got < 0.8


def test_each_predicate_is_worked_out_once(spark):
    out = A.agent_scores(A.component_scores(spark.createDataFrame([artifact("x", **FULL)], A.ARTIFACT), ("documentation",)))
    plan = out.select("artifact_name", "score", "justification")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Contains\(docs#\d+, reproduce\)", plan)) == 1 and len(re.findall(r"RLIKE\(readme#\d+, ", plan)) == 2
    assert not re.search(r"lower\((readme|docs|readmes)#", plan)


def test_readme_marks_as_the_survey_words_them(spark):
    rng = random.Random(14)
    made = ["".join(rng.choice("\n\n \t a1#-*[]]()(") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([artifact(str(i), documentation_files=[("README.md", x.split("\n"))]) for i, x in enumerate(made)], A.ARTIFACT)
    found = A.flags({"PRE06", "PRE07"})
    got = {int(r[0]): (r[1], r[2]) for r in A.texts(df).select("artifact_name", found["PRE06"], found["PRE07"]).collect()}
    want = {i: (bool(re.search(r"(?m)^\s+[a-zA-Z]", x)), bool(re.search(r"(?m)^#{1,6}\s+|^[\s]*[-*+]\s+|\[.*\]\(.*\)", x))) for i, x in enumerate(made)}
    assert got == want and len(set(want.values())) == 4


def test_many_blank_lines_and_brackets_are_read_in_linear_time(spark):
    n, began = 200_000, time.monotonic()
    texts = {"blank": ["x", *[""] * n, "1"], "open": ["x" + "[" * n], "links": ["x[" + "](" * n]}
    df = spark.createDataFrame([artifact(k, documentation_files=[("README.md", x)]) for k, x in texts.items()], A.ARTIFACT)
    found = A.flags({"PRE06", "PRE07"})
    assert [tuple(r) for r in A.texts(df).select(found["PRE06"], found["PRE07"]).collect()] == [(False, False)] * 3
    assert time.monotonic() - began < 40
