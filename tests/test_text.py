from pyspark.sql import functions as F

from strataforge.functions import files as P
from strataforge.functions import text as X


def one(spark, value, **columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(k) for k, c in columns.items()]).first()


def test_headings_and_sections(spark):
    text = "# Title\nbody\n## Install it \n#\nplain # no"  # a lone mark takes the next line, as white space may be a line break
    row = one(spark, text, h=X.headings("t"), s=X.section_titles("t"))
    assert row["h"] == ["title", "install it"]
    assert row["s"] == ["Title", "Install it ", "plain # no"]


def test_markdown_features(spark):
    text = "* a\n- b\n1. c\n| x | y |\n![architecture](a.png)\n[x](http://a.b) [y](docs/z)"
    row = one(spark, text, b=X.bullet_lines("t"), n=X.numbered_lines("t"), tb=X.table_lines("t"), i=X.images("t"), o=X.outbound(X.links("t")))
    assert (row["b"], row["n"], row["tb"], row["i"], row["o"]) == (2, 1, 1, 1, ["http://a.b"])


def test_parsers(spark):
    row = one(spark, "a>=1\nb==2\n# no\nc\n", r=X.requirements("t"))
    assert [(r["name"], r["version"]) for r in row["r"]] == [("a", "1"), ("b", "2"), ("c", None)]
    row = one(spark, '{"dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}', r=X.package_json("t"))
    assert [tuple(r) for r in row["r"]] == [("x", "1", False), ("y", "2", True)]
    row = one(spark, "import os.path\nfrom numpy import x\nfrom . import y\n", r=X.python_imports("t"))
    assert row["r"] == ["os", "numpy"]
    row = one(spark, "FROM a:1\nRUN x\nFROM b\n", r=X.base_images("t"))
    assert row["r"] == ["a:1", "b"]


def test_urls_and_durations(spark):
    rows = spark.createDataFrame([("https://a.b/c",), ("not a url",), (None,)], "t string").select(X.is_url("t").alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, False]
    rows = spark.createDataFrame([(3.25,), (65.0,), (3700.0,)], "s double").select(X.duration("s").alias("d")).collect()
    assert [r["d"] for r in rows] == ["3.3s", "1m 5s", "1h 1m"]


def test_flags_on_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("MIT License",)], "t string").select(X.has_any("t", X.LICENSE_WORDS).alias("f"), X.jargon_ratio(F.coalesce("t", F.lit(""))).alias("j")).collect()
    assert [r["f"] for r in rows] == [False, False, True] and all(r["j"] == 0 for r in rows)


def test_file_kinds(spark):
    paths = ["LICENSE", "docs/a.md", "Dockerfile", "Makefile", "src/x.py", "data/a.csv", "conf/a.yml", "x.unknown", "node_modules/a.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.category("p").alias("c"), P.excluded("p").alias("e"), P.language("p").alias("l")).collect()
    assert [r["c"] for r in rows] == ["license", "documentation", "docker", "build", "code", "data", "config", None, "code"]
    assert [r["e"] for r in rows] == [False] * 8 + [True]
    assert rows[4]["l"] == "python"


def test_guideline_names_and_safe_names(spark):
    k, n, y = P.guideline_parts("p")
    rows = spark.createDataFrame([("x/13_icse_2025.md",), ("2_asia_ccs_2024.md",), ("bad.md",)], "p string").select(k.alias("k"), n.alias("n"), y.alias("y")).collect()
    assert [tuple(r) for r in rows] == [("13", "ICSE", 2025), ("2", "ASIA CCS", 2024), ("", "", None)]
    rows = spark.createDataFrame([("a:b?.txt",), ("con",), ("...",)], "p string").select(P.safe_name("p").alias("s")).collect()
    assert [r["s"] for r in rows] == ["a_b_.txt", "_con", "unnamed"]
