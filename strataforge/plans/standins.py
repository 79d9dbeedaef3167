"""The driver's tables seen as the model's: artifact files, venue weights, scores, a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, file, text): documents as files of the artifact named by their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("artifact"), F.col("doc_id").alias("file"), "text")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(venue, dimension, weight): share of a nation's revenue by market segment."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_order = line.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    rows = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    from ..operators.statistics import shares

    sums = rows.groupBy(F.col("n_name").alias("venue"), F.col("c_mktsegment").alias("dimension")).agg(F.sum("v").alias("v"))
    return shares(sums, "v", ["venue"], "weight").select("venue", "dimension", F.round("weight", 9).alias("weight"))


WEIGHTS_SQL = """
w0 AS (SELECT n_name AS venue, c_mktsegment AS dimension, sum(l_extendedprice * (1 - l_discount)) AS v
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
weights AS (SELECT venue, dimension, round(v / sum(v) OVER (PARTITION BY venue), 9) AS weight FROM w0)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled document: score and accepted, text features, flags."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    low = F.lower("text")
    rows = docs.join(labels, "doc_id")
    return rows.select(
        "doc_id",
        F.col("quality").cast("double").alias("score"),
        (F.col("quality") == 1).alias("accepted"),
        F.length("text").cast("double").alias("n_chars"),
        F.size(X.lines("text")).cast("double").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\S+")).cast("double").alias("n_words"),
        F.contains(low, F.lit("license")).alias("has_license"),
        (F.col("lang") == "en").alias("is_english"),
        (F.length("text") > 1000).alias("is_long"),
        F.contains(F.col("text"), F.lit("|")).alias("has_tables"),
        (F.col("toxic") == 1).alias("flagged"),
    )


FEATURES_SQL = r"""
features AS (SELECT d.doc_id, quality::DOUBLE AS score, quality = 1 AS accepted, length(text)::DOUBLE AS n_chars, len(string_split(text, chr(10)))::DOUBLE AS n_lines,
       len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::DOUBLE AS n_words, contains(lower(text), 'license') AS has_license, lang = 'en' AS is_english,
       length(text) > 1000 AS is_long, contains(text, '|') AS has_tables, toxic = 1 AS flagged
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
FLAGS = ["has_license", "is_english", "is_long", "has_tables", "flagged"]
NUMBERS = ["n_chars", "n_lines", "n_words"]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, name) of regions, nations, customers and suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("region").select(F.concat(F.lit("R"), "r_regionkey"), F.lit("Region"), "r_name"),
        t("nation").select(F.concat(F.lit("N"), "n_nationkey"), F.lit("Nation"), "n_name"),
        t("customer").select(F.concat(F.lit("C"), "c_custkey"), F.lit("Customer"), "c_name"),
        t("supplier").select(F.concat(F.lit("S"), "s_suppkey"), F.lit("Supplier"), F.concat(F.lit("s"), "s_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("id", "label", "name")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, type, dst): CONTAINS down to customers and suppliers; ORDERED from customers to suppliers of their orders."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    parts = [
        t("nation").select(F.concat(F.lit("R"), "n_regionkey"), F.lit("CONTAINS"), F.concat(F.lit("N"), "n_nationkey")),
        t("customer").select(F.concat(F.lit("N"), "c_nationkey"), F.lit("CONTAINS"), F.concat(F.lit("C"), "c_custkey")),
        t("supplier").select(F.concat(F.lit("N"), "s_nationkey"), F.lit("CONTAINS"), F.concat(F.lit("S"), "s_suppkey")),
        line.select(F.concat(F.lit("C"), "o_custkey"), F.lit("ORDERED"), F.concat(F.lit("S"), "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("src", "type", "dst")


GRAPH_SQL = """
nodes AS (SELECT 'R' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Customer', c_name FROM customer UNION ALL SELECT 'S' || s_suppkey, 'Supplier', 's' || s_suppkey FROM supplier),
edges AS (SELECT 'R' || n_regionkey AS src, 'CONTAINS' AS type, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'CONTAINS', 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'CONTAINS', 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'C' || o_custkey, 'ORDERED', 'S' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# What artifacts are dealt from: each holds the entries, phrases, lines, license and URL that its id names.
PATHS = (
    "README.md", "docs/readme.txt", "docs/api.md", "CONTRIBUTING.md", "contribute.txt", "Dockerfile", "docker-compose.yml", "requirements.txt", "package.json", "pom.xml", "Cargo.toml", "go.mod", "environment.yml",
    "setup.py", "install.sh", "scripts/setup.sh", "Makefile", "build.gradle", "dist/app.zip", "src/main.py", "src/app.py", "src/cli.py", "src/run.py", "start.py", "index.py", "src/__init__.py", "src/module_a.java", "web/index.html",
    "web/style.css", "web/app.js", "run.bat", "example_one.ipynb", "tutorial-two.ipynb", "notebooks/playNotebook.ipynb", "demo.cpp", "tests/helper.py", "test_main.py", "main_test.py", "validate.py", "validators.py", "verification.txt",
    "eval.py", "benchmark-speed.py", "timing.log", "metrics.csv", "data/items.bin", "metadata/items.bin", "datasets/items.bin", "big/datasets/items.parquet", "preprocess.py", "clean.R", "config.yaml", "settings.ini", "params.toml",
    "venv/pip.cfg", "conda.lock", "pylint.rc", ".eslintrc", ".gitignore", ".git", "CHANGELOG.md", "VERSION", "history.rst", "issue_template.txt", "bugs.txt", "feedback.html", "TODO", "gui_tkinter.py", "mobileView.js", "adaptive.css", "a.py.bak",
)
PHRASES = (
    "purpose", "provenance", "citation", "Install", "Requirements", "prerequisites", "usage", "How to use", "quick start", "```", "    indented", "# Title", "* item", "[a](b)", "doi.org", "DOI.ORG", "10.1145", "license", "reproduce", "metrics",
    "architecture", "design", "FAQ", "debug", "hardware", "GPU", "disk space", "software", "c++", "dataset", "schema", "http://x.org", "HTTPS://X.ORG", "accuracy", "f1", "quality assurance", "reliability", "version", "Changelog", "verify", "deploy",
    "hosting", "reuse", "customize", "1. go", "step 2", "conda", "npm", "maven", "fix", "confirm", "hello world", "tutorial", "python x.py", "Python y.py", "./run", "curl -O", "flag", "output", "should see", "scenario", "workflow", "paper results",
    "precision", "baseline", "state-of-the-art", "intuitive", "user-friendly", "beginner", "walkthrough", "manual", "screen reader", "font size", "update", "latest",
)
CODE_LINES = (
    "import os", "  import sys", "Import x", "from a import b", "try:", "catch (E e)", "raise ValueError", "an Error", "def f(a, b):", '"""Says what."""', "class A(B):", "DEF g(x)", "args.x", "Args.x", "config[1]", "@property", "x = 1",
    "print('error')", "return (1, error)", "logging.info(x)", "validate(x)", "alert", "retry", "fallback", "open('f(", "')", "raise",
)
LICENSES = ("MIT License", "Apache License", "GPL", "all rights reserved", "CC-BY 4.0", "proprietary", "public domain")
URLS = ("https://zenodo.org/record/1", "https://github.com/a/b", "https://doi.org/10.5281/x", "", "gitlab.com/a", "https://Dataverse.org/x", "https://example.org/v10.2", "https://github.com/zenodo", "ftp://osf.io", "http://?q", "bitbucket.org")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifact rows (``agents.ARTIFACT``'s columns that predicates read): one a document, whose text its README holds."""
    d = F.col("doc_id")
    fixed = lambda items: F.split(F.lit("\n".join(items)), "\n")  # noqa: E731  one literal, folded to an array

    def dealt(items, step: int, share: int):
        return F.filter(fixed(items), lambda x, i: (d * (i + step) + i) % 97 < 97 // share)

    def files(*made):
        return F.filter(F.array(*(F.when(keep, F.struct(F.lit(path).alias("path"), content.alias("content"))) for keep, path, content in made)), lambda f: f.isNotNull())

    guide = dealt(PHRASES, 5, 23)
    readme = F.concat(dealt(PHRASES, 2, 19), F.split(F.coalesce("text", F.lit("")), "\n"))
    code = lambda j: F.filter(fixed(CODE_LINES), lambda x, i: (d + j * 5 + i * 3) % 11 == 0)
    license_line = lambda i: F.array(F.element_at(fixed(LICENSES), (i % len(LICENSES)).cast("int") + 1))
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("artifact_name"),
        F.when(d % 4 == 0, None).when(d % 4 == 1, "").otherwise(F.col("source")).alias("repository_name"),
        F.when(d % 11 != 0, F.element_at(fixed(URLS), (d % len(URLS)).cast("int") + 1)).alias("repository_url"),
        F.transform(dealt(PATHS, 3, 7), lambda p: F.struct(F.substring_index(p, "/", -1).alias("name"), p.alias("path"))).alias("repository_structure"),
        files((d % 3 == 0, "docs/guide.md", guide), (d % 4 != 0, "README.md", readme), (d % 5 == 0, "docs/Readme.txt", guide)).alias("documentation_files"),
        files(*((d % 5 > j, f"f{j}.py", code(j)) for j in range(4))).alias("code_files"),
        files((d % 3 == 1, "LICENSE", license_line(d)), ((d % 3 == 1) & (d % 2 == 1), "LICENSE.2", license_line(d + 3))).alias("license_files"),
        files((F.lit(False), "", guide)).alias("docker_files"),
    )


def _dealt(d, items: tuple[str, ...], step: int, share: int):
    return F.filter(F.split(F.lit("\n".join(items)), "\n"), lambda x, i: (d * (i + step) + i) % 97 < 97 // share)


def readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, document, text): each document as the README of an artifact, below lines that point at some paths."""
    d = F.col("doc_id")
    seen = F.transform(_dealt(d, PATHS, 4, 5), lambda p: F.concat(F.lit("see "), p))
    return table(spark, sf_dir, "documents").select(d.alias("artifact"), d.alias("document"), F.concat_ws("\n", seen, "text").alias("text"))


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, path): the files of the artifacts of ``readmes``."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(d.alias("artifact"), F.explode(_dealt(d, PATHS, 3, 7)).alias("path"))


MENTIONS_SQL = f"""
paths(i, path) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PATHS))}),
f AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name FROM documents, paths WHERE (doc_id * (i + 3) + i) % 97 < 13),
r AS (SELECT doc_id, concat_ws(chr(10), string_agg('see ' || path, chr(10) ORDER BY i) FILTER (WHERE (doc_id * (i + 4) + i) % 97 < 19), first(text)) AS text FROM documents, paths GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(string_split(path, '/')[:-2]) AS folder FROM f),
e AS (SELECT doc_id AS artifact, 'DESCRIBES' AS type, path AS target, ((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM f JOIN r USING (doc_id) WHERE contains(text, name)
  UNION ALL SELECT doc_id, 'MENTIONS', folder, ((length(text) - length(replace(text, folder || '/', ''))) // (length(folder) + 1))::BIGINT FROM g JOIN r USING (doc_id) WHERE contains(text, folder || '/'))"""


#: Phrases of documentation signals and near misses, dealt one to a document.
SIGNAL_PHRASES = ("python run.py", "python3  a_b.py", "./x.sh", "../x.sh", "python x", "FAQ", "Report bug", "Sample output", "EXPORT A=1", "Config File", "customize it", "set seed", "Colab", "test script", "arXiv:1", "nothing", "reset", "Frequently Asked Questions", "issue tracker", "advanced usage")
SIGNAL_SQL = "list_extract([" + ", ".join(f"'{p}'" for p in SIGNAL_PHRASES) + f"], (doc_id % {len(SIGNAL_PHRASES)} + 1)::INT)"


def signal_phrase():
    return F.element_at(F.array(*map(F.lit, SIGNAL_PHRASES)), (F.col("doc_id") % len(SIGNAL_PHRASES) + 1).cast("int"))


MORE_PATHS = (*PATHS, "src/db/schema.sql", "env/x.py", ".sublime-text/a", ".pnp.cjs/b", "a/.Trash-1", "run.log", "Logs/x", "logs/x", "Setup.py", "CHANGELOG.rst", "docs/MY_LICENCE.txt", "out/a.csv", ".DS_Store", "lib/x.TS", "a.b/readme")


def dealt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path) of the paths that each document's artifact is dealt."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(_dealt(d, MORE_PATHS, 8, 6)).alias("path"))


_OUT = "'.git', '.svn', '.hg', '.bzr', 'node_modules', 'bower_components', '.yarn', '.pnp', '__pycache__', '.venv', 'venv', 'env', '.env', 'build', 'dist', 'out', 'output', 'target', 'bin', 'obj', '.idea', '.vscode', 'logs', 'log'"
KINDS_SQL = f"""
paths(i, path) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(MORE_PATHS))}),
d AS (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS low, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS x FROM documents, paths WHERE (doc_id * (i + 8) + i) % 97 < 16),
k AS (SELECT *, len(list_filter(string_split(path, '/')[:-2], lambda p: p IN ({_OUT}) OR starts_with(p, '.sublime-') OR starts_with(p, '.pnp.'))) > 0 OR name IN ('.DS_Store', 'Thumbs.db', 'desktop.ini', '.AppleDouble', '.LSOverride') OR starts_with(name, '.Trash-') OR x IN ('.log', '.tmp', '.swp', '.swo') AND right(name, 4) IN ('.log', '.tmp', '.swp', '.swo') AS excluded,
  contains(low, 'readme') OR contains(low, 'license') OR contains(low, 'licence') OR low IN ('makefile', 'dockerfile', 'setup.py', 'requirements.txt', 'package.json', 'pom.xml') OR regexp_replace(low, '(.)\\.[^.]*$', '\\1') IN ('contributing', 'changelog', 'makefile', 'dockerfile', 'setup.py', 'requirements.txt', 'package.json', 'pom.xml') AS important,
  name IN ('Makefile', 'CMakeLists.txt', 'build.gradle', 'pom.xml', 'package.json', 'requirements.txt') AS build, x IN ('.csv', '.json', '.xml', '.sql', '.db', '.sqlite') AS data, x IN ('.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf') AS config,
  CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.cpp' THEN 'cpp' WHEN '.c' THEN 'c' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.rb' THEN 'ruby' WHEN '.php' THEN 'php' WHEN '.r' THEN 'r' WHEN '.sh' THEN 'shell' WHEN '.sql' THEN 'sql' ELSE 'unknown' END AS language FROM d)"""
