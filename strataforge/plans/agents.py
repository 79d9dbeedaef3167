"""Six rule agents over artifact rows: predicates and component weights as data, one generic plan.

An artifact row has repository_structure (name, path, size), documentation, code and
license files with their lines, and docker files.  Every predicate is one flag;
a component is the capped weighted sum of its flags, an agent the mean of its
components, the total the weighted sum of the agents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("size_kb", T.DoubleType())])
_TEXT = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.ArrayType(T.StringType()))])
#: One analysis document a row; lists may be null.
ARTIFACT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("artifact_name", "repository_name", "repository_url")]
    + [T.StructField("success", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(_FILE)) for c in ("repository_structure", "build_files", "data_files", "config_files")]
    + [T.StructField(c, T.ArrayType(_TEXT)) for c in ("documentation_files", "code_files", "license_files", "docker_files")]
    + [T.StructField("tree_structure", T.ArrayType(T.StringType())), T.StructField("repo_size_mb", T.DoubleType())]
)

# Raw scores and weights of the six dimensions.
WEIGHTS = {"reproducibility": 0.207, "documentation": 0.154, "accessibility": 0.139, "usability": 0.198, "experimental": 0.148, "functionality": 0.155}
ACCEPT = 0.50

# What each predicate looks for: (where, how, words).
PREDICATES = {
    "PRE02": ("sources", "any", ("doi.org", "10.",)),
    "PRE03": ("license", "any", ("mit license", "apache license", "gpl", "bsd license", "creative commons", "cc-by", "cc0", "public domain", "mozilla public license", "eclipse public license",)),
    "PRE04": ("readmes", "any", ("license",)),
    "PRE08": ("readmes", "any", ("setup", "install", "installation", "requirements", "dependencies", "prerequisites", "environment", "configuration",)),
    "PRE09": ("readmes", "any", ("usage", "how to use", "examples", "commands", "run", "execute", "quick start", "getting started",)),
    "PRE10": ("names", "exact", ("dockerfile", "docker-compose.yml", "docker-compose.yaml",)),
    "PRE11": ("names", "exact", ("requirements.txt", "package.json", "pom.xml", "build.gradle", "cargo.toml",)),
    "PRE13": ("docs", "any", ("reproduce", "replicate", "results", "experiments", "evaluation", "benchmark", "performance", "metrics",)),
    "PRE14": ("names", "any", ("api", "docs",)),
    "PRE15": ("docs", "any", ("architecture", "design", "structure", "overview", "system",)),
    "PRE16": ("docs", "any", ("troubleshooting", "faq", "issues", "problems", "debug",)),
    "PRE17": ("names", "any", ("contributing", "contribute",)),
    "PRE18": ("docs", "any", ("hardware", "cpu", "gpu", "memory", "ram", "storage", "disk space", "processor", "cores", "threads", "minimum requirements",)),
    "PRE19": ("docs", "any", ("software", "operating system", "os", "python", "java", "c++", "dependencies", "libraries", "packages", "frameworks", "version", "requirements",)),
    "PRE20": ("names", "exact", ("requirements.txt", "package.json", "pom.xml", "build.gradle", "cargo.toml", "go.mod", "environment.yml",)),
    "PRE22": ("docs", "any", ("dataset", "data", "format", "schema", "columns", "fields", "attributes", "data description", "data format", "data structure",)),
    "PRE24": ("names", "any", ("preprocess", "clean", "transform", "prepare",)),
    "PRE27": ("docs", "any", ("results", "performance", "metrics", "accuracy", "precision", "recall", "f1", "benchmark", "evaluation", "comparison",)),
    "PRE28": ("docs", "any", ("validation", "verification", "testing", "quality assurance", "qa", "correctness", "reliability",)),
    "PRE30": ("names", "ends", (".txt", ".md", ".pdf", ".csv", ".json", ".xml", ".yaml", ".yml", ".zip", ".tar.gz", ".py", ".ipynb",)),
    "PRE33": ("code_files", "cased", (r"(?m)^import\s+", r"(?m)^from\s+.*\s+import",)),
    "PRE34": ("names", "any", ("config", "settings", "env", "ini", "yaml", "yml", "json",)),
    "PRE35": ("code_files", "regex", (r"try\s*:", r"except\s*:", r"catch\s*\(", r"finally\s*:", r"raise\s+", r"throw\s+", "error", "exception",)),
    "PRE40": ("docs", "any", ("verify", "verification", "validate", "validation", "test", "testing", "quality", "assurance", "correctness", "reliability",)),
    "PRE41": ("names", "any", ("lint", "flake8", "pylint", "eslint", "checkstyle",)),
    "PRE42": ("names", "any", ("benchmark", "performance", "speed", "timing",)),
    "PRE43": ("names", "exact", ("dockerfile", "docker-compose.yml", "docker-compose.yaml",)),
    "PRE44": ("names", "any", ("setup.py", "install", "package", "dist", "build",)),
    "PRE45": ("names", "any", ("venv", "env", "virtualenv", "conda", "environment.yml",)),
    "PRE46": ("names", "any", ("build", "make", "compile", "install.sh", "setup.sh",)),
    "PRE47": ("docs", "any", ("deploy", "deployment", "production", "server", "hosting", "install", "setup", "configuration",)),
    "PRE49": ("names", "any", ("config", "settings", "params", "parameters",)),
    "PRE50": ("code_files", "cased", (r"def\s+\w+\s*\([^)]*\)", r"class\s+\w+\s*\([^)]*\)", r"args\.", r"kwargs\.", r"config\[", r"settings\[",)),
    "PRE51": ("docs", "any", ("reuse", "reusable", "modular", "component", "library", "api", "interface", "extend", "customize", "configure",)),
    "PRE52": ("code_files", "cased", (r'def\s+\w+\s*\([^)]*\):\s*"""[^"]*"""', r'class\s+\w+\s*\([^)]*\):\s*"""[^"]*"""', "@property", "@staticmethod", "@classmethod",)),
    "PRE53": ("documentation_files", "regex", (r"\d+\.\s+", r"[-*]\s+", r"step\s+\d+", r"first\s+", r"second\s+", r"third\s+",)),
    "PRE54": ("docs", "any", ("environment", "virtual", "venv", "conda", "docker", "container", "python", "java", "node", "npm", "pip", "install",)),
    "PRE55": ("docs", "any", ("install", "dependency", "requirement", "package", "library", "pip install", "npm install", "maven", "gradle",)),
    "PRE56": ("docs", "any", ("troubleshoot", "troubleshooting", "faq", "common issues", "problems", "errors", "debug", "fix",)),
    "PRE57": ("docs", "any", ("verify", "test", "check", "validate", "confirm", "run test", "hello world", "example", "demo",)),
    "PRE58": ("docs", "any", ("example", "usage", "how to", "basic", "simple", "quick start", "getting started", "demo", "tutorial",)),
    "PRE59": ("documentation_files", "cased", (r"python\s+\w+\.py", r"java\s+\w+", r"node\s+\w+", r"\./[\w-]+", r"bash\s+[\w-]+", r"curl\s+",)),
    "PRE60": ("docs", "any", ("parameter", "argument", "option", "flag", "--", "-", "input", "output", "config", "setting",)),
    "PRE61": ("docs", "any", ("output", "result", "example", "sample", "expected", "should see", "will produce", "generates",)),
    "PRE62": ("docs", "any", ("use case", "scenario", "example", "case study", "application", "workflow", "pipeline", "process",)),
    "PRE63": ("docs", "any", ("reproduce", "replicate", "results", "experiments", "evaluation", "benchmark", "performance", "metrics", "paper results",)),
    "PRE64": ("docs", "any", ("expected", "should", "will", "output", "result", "accuracy", "precision", "recall", "f1", "performance",)),
    "PRE65": ("names", "any", ("benchmark", "performance", "speed", "timing", "eval",)),
    "PRE66": ("names", "any", ("validate", "validation", "verify", "test", "check",)),
    "PRE67": ("docs", "any", ("paper", "publication", "table", "figure", "comparison", "baseline", "state-of-the-art", "sota", "previous work",)),
    "PRE68": ("docs", "any", ("intuitive", "easy to use", "user-friendly", "simple", "straightforward", "clear", "obvious", "self-explanatory", "logical",)),
    "PRE69": ("docs", "any", ("basic", "advanced", "beginner", "expert", "simple", "complex", "step by step", "progressive", "tutorial", "guide",)),
    "PRE70": ("docs", "any", ("guide", "tutorial", "help", "assistance", "support", "walkthrough", "how to", "instructions", "manual", "guidebook",)),
    "PRE72": ("docs", "any", ("accessibility", "accessible", "screen reader", "keyboard navigation", "high contrast", "font size", "color blind", "disability",)),
    "PRE73": ("names", "any", ("html", "css", "js", "web", "app", "server",)),
    "PRE74": ("names", "any", ("cli", "command", "shell", "script", "main.py",)),
    "PRE75": ("names", "any", ("gui", "tkinter", "pyqt", "wx", "gtk", "ui",)),
    "PRE76": ("names", "any", ("interactive", "notebook", "jupyter", "demo", "playground",)),
    "PRE77": ("names", "any", ("responsive", "mobile", "adaptive", "flexible",)),
    "PRE78": ("code_files", "regex", (r"try\s*:", r"except\s*:", r"catch\s*\(", r"finally\s*:", r"raise\s+", r"throw\s+", "error", "exception",)),
    "PRE79": ("code_files", "regex", (r"print\s*\([^)]*error[^)]*\)", r"logging\.[^)]*error[^)]*\)", r"raise\s+[^)]*Error[^)]*\)", r"return\s+[^)]*error[^)]*\)",)),
    "PRE80": ("code", "any", ("validate", "validation", "check", "verify", "confirm", "feedback", "message", "notification", "alert",)),
    "PRE81": ("code", "any", ("recover", "restore", "backup", "retry", "fallback", "alternative", "default", "safe", "secure",)),
    "PRE82": ("names", "exact", (".git", ".gitignore", ".gitattributes",)),
    "PRE83": ("names", "any", ("changelog", "version", "history", "log",)),
    "PRE84": ("names", "any", ("feedback", "issue", "bug", "report", "contact",)),
    "PRE85": ("docs", "any", ("update", "version", "changelog", "history", "revision", "latest", "current", "new", "improved",)),
    "PRE86": ("names", "any", ("issue", "bug", "tracker", "todo", "fixme",)),}

# Components of each dimension and the weights of their predicates.
COMPONENTS = {
    "accessibility": {
        "availability": (("has_name", 0.3), ("has_url", 0.4), ("url_valid", 0.3)),
        "archival": (("archive_host", 1.0), ("code_host", 0.5), ("other_host", 0.3), ("PRE02", 0.2)),
        "licensing": (("license_file", 0.4), ("license_open", 0.4), ("license_closed", 0.2), ("PRE04", 0.2)),
    },
    "documentation": {
        "readme": (("has_readme", 0.2), ("purpose", 0.2), ("provenance", 0.2), ("setup_section", 0.2), ("usage_section", 0.2), ("PRE06", 0.1), ("PRE07", 0.1)),
        "setup_instructions": (("PRE08", 0.4), ("setup_files", 0.3), ("PRE10", 0.2), ("PRE11", 0.1)),
        "usage_instructions": (("PRE09", 0.3), ("example_files", 0.3), ("PRE12", 0.2), ("PRE13", 0.2)),
        "comprehensive": (("any_docs", 0.2), ("PRE14", 0.2), ("PRE15", 0.2), ("PRE16", 0.2), ("PRE17", 0.2)),
    },
    "experimental": {
        "experimental_setup": (("PRE18", 0.3), ("PRE19", 0.3), ("config_files", 0.2), ("PRE20", 0.2)),
        "data_availability": (("PRE21", 0.4), ("PRE22", 0.3), ("PRE23", 0.2), ("PRE24", 0.1)),
        "validation_evidence": (("PRE25", 0.3), ("PRE26", 0.3), ("PRE27", 0.2), ("PRE28", 0.2)),
        "artifact_packaging": (("PRE29", 0.3), ("PRE30", 0.3), ("PRE31", 0.2), ("PRE32", 0.2)),
    },
    "functionality": {
        "executability": (("main_file", 0.3), ("script_files", 0.2), ("PRE33", 0.2), ("PRE34", 0.1), ("PRE35", 0.2)),
        "consistency": (("ten_entries", 0.2), ("PRE36", 0.2), ("two_docs", 0.2), ("three_code", 0.2), ("PRE37", 0.2)),
        "verification": (("PRE38", 0.3), ("PRE39", 0.2), ("PRE40", 0.2), ("PRE41", 0.2), ("PRE42", 0.1)),
        "preparation": (("PRE43", 0.3), ("PRE44", 0.2), ("PRE45", 0.2), ("PRE46", 0.2), ("PRE47", 0.1)),
    },
    "reproducibility": {
        "reusability": (("PRE48", 0.3), ("PRE49", 0.2), ("PRE50", 0.2), ("PRE51", 0.2), ("PRE52", 0.1)),
        "setup_clarity": (("PRE53", 0.3), ("PRE54", 0.2), ("PRE55", 0.2), ("PRE56", 0.2), ("PRE57", 0.1)),
        "usage_clarity": (("PRE58", 0.3), ("PRE59", 0.2), ("PRE60", 0.2), ("PRE61", 0.2), ("PRE62", 0.1)),
        "result_replication": (("PRE63", 0.3), ("PRE64", 0.2), ("PRE65", 0.2), ("PRE66", 0.2), ("PRE67", 0.1)),
    },
    "usability": {
        "user_experience": (("PRE68", 0.3), ("PRE69", 0.2), ("PRE70", 0.2), ("PRE71", 0.2), ("PRE72", 0.1)),
        "user_interface": (("PRE73", 0.3), ("PRE74", 0.2), ("PRE75", 0.2), ("PRE76", 0.2), ("PRE77", 0.1)),
        "error_handling": (("PRE78", 0.3), ("PRE79", 0.3), ("PRE80", 0.2), ("PRE81", 0.2)),
        "review_process": (("PRE82", 0.3), ("PRE83", 0.2), ("PRE84", 0.2), ("PRE85", 0.2), ("PRE86", 0.1)),
    },
}
# Hosts by kind.
ARCHIVE_HOSTS = ("zenodo", "figshare", "dataverse", "dryad", "osf.io")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
#: Components that the wording of a justification leaves out.
UNWORDED = ("comprehensive", "artifact_packaging", "preparation", "result_replication", "review_process")


def _content(file: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(file["content"], F.array().cast("array<string>")))


def texts(df: DataFrame) -> DataFrame:
    """Adds what predicates look at: lower-cased names, paths, docs, code, license and READMEs; URL and docs as they are written.

    ``readme`` is the first README as it is written, ``low_readme`` its lower case, ``readmes`` all of them. ``low``
    holds the documents one by one, so that each is put into lower case once for all columns made of them.

    A missing repository_structure is rebuilt from the paths of the other file lists.
    """
    files = ("documentation_files", "code_files", "license_files", "docker_files")
    listed = reduce(lambda a, c: F.concat(a, F.coalesce(F.transform(c, lambda f: f["path"]), F.array().cast("array<string>"))), files, F.array().cast("array<string>"))
    paths = F.coalesce(F.transform("repository_structure", lambda f: F.coalesce(f["path"], f["name"])), listed)
    own = F.transform("repository_structure", lambda f: F.coalesce(f["name"], F.substring_index(f["path"], "/", -1)))
    written = F.coalesce(own, F.transform(listed, lambda p: F.substring_index(p, "/", -1)))

    def whole(files: Column) -> Column:
        return F.coalesce(F.concat_ws("\n", F.transform(files, _content)), F.lit(""))

    def is_readme(file: Column) -> Column:
        return F.lower(file["path"]).contains("readme")

    low = F.transform("documentation_files", lambda f: F.struct(is_readme(f).alias("readme"), F.lower(_content(f)).alias("text")))
    readmes = F.filter("low", lambda f: f["readme"])
    return (
        df.withColumn("paths", F.transform(paths, F.lower))
        .withColumn("written_names", written)
        .withColumn("names", F.transform("written_names", F.lower))
        .withColumn("written_docs", whole(F.col("documentation_files")))
        .withColumn("low", low)
        .withColumn("docs", F.concat_ws("\n", F.transform("low", lambda f: f["text"])))
        .withColumn("sources", F.concat_ws("\n", "repository_url", "written_docs"))
        .withColumn("code", F.lower(whole(F.col("code_files"))))
        .withColumn("license", F.lower(whole(F.col("license_files"))))
        .withColumn("readmes", F.concat_ws("\n", F.transform(readmes, lambda f: f["text"])))
        .withColumn("low_readme", F.coalesce(F.try_element_at(readmes, F.lit(1))["text"], F.lit("")))
        .withColumn("readme", F.coalesce(_content(F.try_element_at(F.filter("documentation_files", is_readme), F.lit(1))), F.lit("")))
    )


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words; a word that holds another one of them need not be looked for."""
    return reduce(Column.__or__, [text.contains(w) for w in words if not any(v in w for v in words if v != w)])


def _flag(where: str, how: str, words: tuple[str, ...]) -> Column:
    if where == "names":
        if how == "exact":
            return F.exists("names", lambda x: x.isin(*words))
        if how == "ends":
            return F.exists("names", lambda x: reduce(Column.__or__, [x.endswith(w) for w in words]))
        return F.exists("names", lambda x: _any(x, words))
    if how in ("regex", "cased"):  # file by file, so that no match runs from one file into the next
        mark = "(?Uid)" if how == "regex" else "(?Ud)"
        return F.exists(where, lambda f: reduce(Column.__or__, [_content(f).rlike(mark + w) for w in words]))
    return _any(F.col(where), words)


def _n(column: str) -> Column:
    return F.coalesce(F.size(column), F.lit(0))


def flags(wanted: set[str] | None = None) -> dict[str, Column]:
    """Every predicate, or those wanted, as a Column over ``texts`` rows."""
    names, paths, docs, readme, url = F.col("names"), F.col("paths"), F.col("docs"), F.col("readme"), F.lower(F.coalesce("repository_url", F.lit("")))
    plain = F.col("low_readme")
    styles = sum(F.exists("written_names", test).cast("int") for test in (lambda x: x.contains("_"), lambda x: x.contains("-"), lambda x: x.rlike("[a-z][A-Z]")))
    few_styles = F.coalesce(styles, F.lit(0)) <= 2
    archive, code_host = (reduce(Column.__or__, [url.contains(h) for h in hosts]) for hosts in (ARCHIVE_HOSTS, CODE_HOSTS))
    named_test = F.exists(names, lambda x: x.contains("test"))
    has_readme = F.exists("documentation_files", lambda f: F.lower(f["path"]).contains("readme"))

    def some_path(word: str) -> Column:
        return F.exists(paths, lambda x: x.contains(word))

    places = sum(some_path(w).cast("int") for w in ("src", "doc", "test"))
    opened = _flag(*PREDICATES["PRE03"])
    special: dict[str, Callable[[], Column]] = {
        "has_name": lambda: F.col("repository_name") != "",
        "has_url": lambda: url != "",
        "url_valid": lambda: url.rlike("^[a-z][a-z0-9+.-]*://[^/?#]+"),
        "archive_host": lambda: archive,
        "code_host": lambda: code_host & ~archive,
        "other_host": lambda: ~archive & ~code_host,
        "license_file": lambda: _n("license_files") > 0,
        "license_open": lambda: (_n("license_files") > 0) & opened,
        "license_closed": lambda: (_n("license_files") > 0) & ~opened,
        "has_readme": lambda: has_readme,
        "purpose": lambda: _any(plain, ("purpose", "description", "about", "overview")),
        "provenance": lambda: _any(plain, ("provenance", "citation", "reference", "paper")),
        "setup_section": lambda: _any(plain, ("setup", "install", "installation", "requirements")),
        "usage_section": lambda: _any(plain, ("usage", "how to use", "examples", "commands")),
        # As ^\s+[a-zA-Z], and ^#{1,6}\s+|^[\s]*[-*+]\s+|\[.*\]\(.*\), but no blank line or bracket is gone over again from each one before it.
        "PRE06": lambda: readme.contains("```") | readme.rlike(r"(?Udm)^[^\S\n]*\s[a-zA-Z]"),
        "PRE07": lambda: readme.rlike(r"(?Udm)^(?:#{1,6}\s|[^\S\n]*[-*+]\s|[^\[\n]*+\[(?>.*?\]\()[^)\n]*+\))"),
        "setup_files": lambda: F.exists(names, lambda x: x.rlike("setup|install|requirements|dockerfile")),
        "example_files": lambda: F.exists(names, lambda x: x.rlike("example|demo|tutorial|notebook")),
        "PRE12": lambda: F.exists(names, lambda x: x.endswith(".sh") | x.isin("main.py", "app.py", "run.py", "cli.py")),
        "any_docs": lambda: _n("documentation_files") > 0,
        "config_files": lambda: F.exists(names, lambda x: x.rlike("config|env|environment|settings")),
        "PRE21": lambda: F.exists(names, lambda x: x.rlike(r"\.(csv|json|tsv|xlsx|xls|parquet|h5|hdf5)$")) | F.exists(paths, lambda x: x.rlike("data/|dataset/|/datasets/")),
        "PRE23": lambda: docs.contains("dataset") | F.col("written_docs").rlike("https?://"),
        "PRE25": lambda: named_test,
        "PRE26": lambda: F.exists(names, lambda x: x.rlike("eval|benchmark|metrics|performance")),
        "PRE29": lambda: (F.size(names) >= 5) & F.exists(names, lambda x: x.contains("readme")) & F.exists("written_names", lambda x: x.rlike(r"\.(py|java|cpp|js)$")),
        "PRE31": lambda: (_n("documentation_files") >= 2) & has_readme,
        "PRE32": lambda: F.exists(names, lambda x: x.isin("version", "version.txt", "changelog", "changelog.md")) | docs.contains("version") | docs.contains("changelog"),
        "main_file": lambda: F.exists(names, lambda x: x.isin("main.py", "app.py", "run.py", "start.py", "index.py")),
        "script_files": lambda: F.exists(names, lambda x: x.rlike(r"\.(sh|bat|py|js)$")),
        "ten_entries": lambda: F.size(names) >= 10,
        "PRE36": lambda: few_styles,
        "two_docs": lambda: _n("documentation_files") >= 2,
        "three_code": lambda: _n("code_files") >= 3,
        "PRE37": lambda: places >= 2,
        "PRE38": lambda: named_test | some_path("test"),
        "PRE39": lambda: F.exists(names, lambda x: x.rlike("validate|validation|verify|verification")),
        "PRE48": lambda: some_path("module") | F.exists("written_names", lambda x: x.contains("__init__.py")) | (_n("code_files") > 3),
        "PRE71": lambda: few_styles,
    }
    made = {k: (lambda v=v: _flag(*v)) for k, v in PREDICATES.items() if k != "PRE03"} | special
    return {k: F.coalesce(v(), F.lit(False)) for k, v in made.items() if wanted is None or k in wanted}


def _score(found: dict[str, Column], weighted: tuple[tuple[str, float], ...]) -> Column:
    """The weights added in their order and not rounded: 0.3 + 0.2 + 0.2 + 0.1 stays below the tier of 0.8."""
    return F.least(F.lit(1.0), sum((F.when(found[p], w).otherwise(0.0) for p, w in weighted), F.lit(0.0)))


def _held(df: DataFrame, wanted: set[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows of artifact_name and the wanted predicates, each worked out once however often it is read, and their columns."""
    found = flags(wanted)
    return texts(df).select("artifact_name", *(v.alias(k) for k, v in found.items())), {k: F.col(k) for k in found}


def component(df: DataFrame, dimension: str, name: str) -> DataFrame:
    """(artifact_name, score and each predicate of one component, in lower case)."""
    weighted = COMPONENTS[dimension][name]
    rows, found = _held(df, {p for p, _ in weighted})
    return rows.select("artifact_name", _score(found, weighted).alias("score"), *(found[p].alias(p.lower()) for p, _ in weighted))


def component_scores(df: DataFrame, dimensions: tuple[str, ...] | None = None) -> DataFrame:
    """(artifact_name, dimension, component, score, evidence): evidence lists the predicates that hold."""
    chosen = {d: parts for d, parts in COMPONENTS.items() if dimensions is None or d in dimensions}
    held, found = _held(df, {p for parts in chosen.values() for weighted in parts.values() for p, _ in weighted})
    rows = []
    for dimension, parts in chosen.items():
        for name, weighted in parts.items():
            evidence = F.array_compact(F.array(*(F.when(found[p], F.lit(p)) for p, _ in weighted)))
            rows.append(F.struct(F.lit(dimension).alias("dimension"), F.lit(name).alias("component"), _score(found, weighted).alias("score"), evidence.alias("evidence")))
    return held.select("artifact_name", F.explode(F.array(*rows)).alias("r")).select("artifact_name", "r.*")


def agent_scores(components: DataFrame) -> DataFrame:
    """(artifact_name, dimension, score, justification, evidence).

    The score is the mean of the components; the justification's tier needs every
    component that it speaks of to reach the bound.
    """
    worded = F.when(~F.col("component").isin(*UNWORDED), F.col("score"))
    out = components.groupBy("artifact_name", "dimension").agg(
        F.round(F.avg("score"), 6).alias("score"), F.min(worded).alias("least"), F.sort_array(F.flatten(F.collect_list("evidence"))).alias("evidence")
    )
    tier = F.when(F.col("least") >= 0.8, "excellent").when(F.col("least") >= 0.6, "good").when(F.col("least") >= 0.4, "fair").otherwise("poor")
    return out.withColumn("justification", F.concat(tier, F.lit(" "), "dimension")).drop("least")


def reviewed(agents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Agent scores raised to a reviewer's (artifact_name, dimension, review, comment); a review never lowers one."""
    joined = agents.join(reviews, ["artifact_name", "dimension"], "left")
    return joined.withColumn("score", F.greatest("score", F.coalesce("review", F.lit(0.0)))).withColumn("justification", F.coalesce("comment", "justification")).drop("review", "comment")


def decisions(agents: DataFrame, weights: dict[str, float] | None = None, accept: float = ACCEPT) -> DataFrame:
    """(artifact_name, total, accepted, strengths, weaknesses, recommendations): a missing agent counts 0."""
    table = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])
    weight = F.coalesce(F.try_element_at(table, F.col("dimension")), F.lit(0.0))

    def named(test: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(test, F.col("dimension"))))

    total = F.round(F.sum(F.col("score") * weight), 6)
    out = agents.groupBy("artifact_name").agg(total.alias("total"), named(F.col("score") >= 0.8).alias("strengths"), named(F.col("score") < 0.5).alias("weaknesses"), named(F.col("score") < 0.6).alias("improve"))
    advice = F.transform("improve", lambda d: F.concat(F.lit("Improve "), d))
    return out.withColumn("accepted", F.col("total") >= accept).withColumn("recommendations", advice).drop("improve")


def evaluate(artifacts: DataFrame) -> DataFrame:
    """The decision on every artifact that is not marked as failed; no success mark counts as success."""
    return decisions(agent_scores(component_scores(artifacts.filter("coalesce(success, true)"))))
