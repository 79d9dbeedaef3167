"""Text functions as Column expressions: signals, Markdown features, headings, parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the documentation signals.
LICENSE_WORDS = ("mit license", "apache license", "gpl", "lgpl", "bsd license", "cc-by", "creative commons", "epl", "eupl", "mpl", "unlicense")
CITATION_WORDS = ("how to cite", "citation", "doi:", "zenodo", "paper url")
AUTHOR_WORDS = ("author", "contributors", "maintainers", "developer")
# Words of troubleshooting, usage, configuration and reproducibility, and commands that run a script.
SIGNALS = {
    "common_issues": ("common error", "common errors", "known issue", "known issues", "faq", "frequently asked questions", "troubleshoot"),
    "bug_guidance": ("report bug", "bug tracker", "issue tracker", "support", "help"),
    "samples": ("sample input", "sample output", "example usage", "cli screenshot", "interface screenshot"),
    "env_config": ("env var", "environment variable", "export ", "set ", "config file", "yaml config", "json config"),
    "customization": ("advanced usage", "advanced configuration", "override default", "customize"),
    "repro_steps": ("data setup", "environment duplication", "random seed", "set seed", "reproducibility", "docker", "colab", "binder", "container"),
    "validation_steps": ("validate results", "test script", "accuracy", "performance metric", "evaluation script", "benchmark"),
    "related_references": ("original research paper", "arxiv", "data source", "related project", "related work", "reference"),
}
COMMANDS = (r"python\s+\w+\.py", r"python3\s+\w+\.py", r"\./\w+\.sh", r"\.\.\/\w+\.sh")
JARGON = ("api", "library", "dataset", "framework", "dependency", "gpu", "docker", "virtualenv", "conda", "cli", "shell", "python", "server", "backend", "runtime", "build", "script", "repository", "compile", "kernel")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "this", "to", "was", "were", "will", "with")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text: Column | str) -> Column:
    """Lines of a text, blank ones too."""
    return F.split(_c(text), "\n")


def filled_lines(text: Column | str) -> Column:
    """Non-blank lines of a text."""
    return F.filter(lines(text), lambda x: F.trim(x) != "")


def joined(content: Column | str) -> Column:
    """An array of lines as one text."""
    return F.concat_ws("\n", _c(content))


def has_any(text: Column | str, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the words; null text holds none."""
    low = F.lower(_c(text))
    out = F.lit(False)
    for word in words:
        out = out | F.contains(low, F.lit(word))
    return F.coalesce(out, F.lit(False))


def signals(text: Column | str) -> dict[str, Column]:
    """Whether a text has each of the documentation signals, by name."""
    command = F.coalesce(F.lower(_c(text)).rlike("|".join(COMMANDS)), F.lit(False))
    return {"example_commands": command} | {name: has_any(text, words) for name, words in SIGNALS.items()}


def count_of(text: Column | str, word: str) -> Column:
    """Occurrences of a plain word, not overlapping."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("long")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+")).cast("long")


def tokens(text: Column | str, least: int = 3) -> Column:
    """Lower-case words of letters and digits, without stopwords, short words and numbers."""
    parts = F.split(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(parts, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\p{N}+$"))


def plain_tokens(text: Column | str) -> Column:
    """The simpler variant: stopwords and punctuation go, all else stays."""
    parts = F.split(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n neighbouring words, joined by a space."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", F.slice(words, i, n)))).otherwise(F.array().cast("array<string>"))


def headings(text: Column | str) -> Column:
    """Heading texts of a Markdown document: marks stripped, lower case, none empty."""
    marked = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    return F.filter(F.transform(marked, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^#+\s*(.*)$", 1)))), lambda x: x != "")


def section_titles(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?m)^#+\s+(.+)$"), F.lit(1))


def bullet_lines(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?m)^\s*[-*+]\s+")).cast("long")


def numbered_lines(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?m)^\s*[0-9]+\.\s+")).cast("long")


def table_lines(text: Column | str) -> Column:
    return F.size(F.filter(lines(text), lambda x: x.contains("|"))).cast("long")


def images(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"!\[[^\]]*\]\([^)]*\)")).cast("long")


def links(text: Column | str) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(_c(text), F.lit(r"\[[^\]]*\]\(([^)]*)\)"), F.lit(1))


def outbound(targets: Column) -> Column:
    return F.filter(targets, lambda x: x.startswith("http://") | x.startswith("https://"))


def collapse(text: Column | str) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def jargon_ratio(text: Column | str) -> Column:
    """Share of words that are jargon once all but letters, digits and _ is gone; 0 for texts under 100 words."""
    words = F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "").isin(*JARGON)))
    return F.when(F.size(words) >= 100, hits / F.size(words)).otherwise(F.lit(0.0))


def readability(words: Column, sentences: Column, syllables: Column, complex_words: Column) -> tuple[Column, Column]:
    """(Flesch-Kincaid grade, Gunning fog) from counts; null where there are no words."""
    per_sentence = F.try_divide(words, F.greatest(sentences, F.lit(1)))
    flesch = 0.39 * per_sentence + 11.8 * F.try_divide(syllables, words) - 15.59
    fog = 0.4 * (per_sentence + 100 * F.try_divide(complex_words, words))
    return flesch, fog


def syllables(text: Column | str) -> Column:
    """Vowel groups, the usual estimate of English syllables."""
    return F.regexp_count(F.lower(_c(text)), F.lit("[aeiouy]+")).cast("long")


def doi(text: Column | str, strict: bool = False) -> Column:
    """Any ``10.`` counts unless ``strict``."""
    return _c(text).rlike(r"\b10\.\d{4,9}/\S+") if strict else has_any(text, ("doi.org", "10."))


def commands(text: Column | str) -> Column:
    """Docker commands, then git commands."""
    return F.concat(*(F.regexp_extract_all(_c(text), F.lit(rf"(?m)^\s*({tool} .*)$"), F.lit(1)) for tool in ("docker", "git")))


def python_imports(text: Column | str) -> Column:
    """Distinct root packages of import lines; relative imports are skipped."""
    found = F.regexp_extract_all(_c(text), F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.split_part(x, F.lit("."), F.lit(1))))


def base_images(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?m)^FROM\s+(\S+)"), F.lit(1))


def requirements(text: Column | str) -> Column:
    """array<struct<name, version>> of a requirements file: ``>=`` before ``==``, comments dropped."""
    rows = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))

    def parse(row: Column) -> Column:
        mark = F.when(row.contains(">="), ">=").otherwise("==")
        version = F.when(row.contains(">=") | row.contains("=="), F.trim(F.split_part(row, mark, F.lit(2))))
        return F.struct(F.trim(F.split_part(row, mark, F.lit(1))).alias("name"), version.alias("version"))

    return F.transform(rows, parse)


def package_json(text: Column | str) -> Column:
    """array<struct<name, version, dev>> of a package.json; null if it does not parse."""
    kind = "map<string,string>"

    def part(key: str, dev: bool) -> Column:
        entries = F.map_entries(F.coalesce(F.from_json(F.get_json_object(_c(text), f"$.{key}"), kind), F.from_json(F.lit("{}"), kind)))
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(dev).alias("dev")))

    return F.concat(part("dependencies", False), part("devDependencies", True))


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """(scheme, host) of a URL; null where it is not one."""
    return F.try_parse_url(_c(url), F.lit("PROTOCOL")), F.try_parse_url(_c(url), F.lit("HOST"))


def is_url(url: Column | str) -> Column:
    scheme, host = url_parts(url)
    return F.coalesce(scheme.isNotNull() & host.isNotNull() & (host != ""), F.lit(False))


def duration(seconds: Column | str) -> Column:
    """Seconds as ``12.3s``, ``4m 5s`` or ``1h 2m``."""
    s = _c(seconds)
    whole = F.floor(s)
    return (
        F.when(s < 60, F.concat(F.format_string("%.1f", s.cast("double")), F.lit("s")))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )


def node_id(kind: Column | str, identifier: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws(":", kind, identifier)), 1, 16)


# Fixed value: words that tell of a setup.
SETUP_WORDS = r"\b(install|setup|configuration|prerequisite)\b"


def setup_complexity(words: Column, docker: Column, builds: Column) -> Column:
    """low, medium or high: Docker 2 points, a build file a half; over 10 setup words 3, over 5 2, any 1."""
    points = docker.cast("int") * 2 + builds * 0.5 + F.when(words > 10, 3).when(words > 5, 2).when(words > 0, 1).otherwise(0)
    return F.when(points <= 2, "low").when(points <= 5, "medium").otherwise("high")
