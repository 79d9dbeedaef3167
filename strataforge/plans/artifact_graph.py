"""The artifact graph from analysis documents, README sections and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as P
from ..functions import text as X

# Ordered keyword groups of section headings.
SECTION_TYPES = {
    "installation": ("install", "setup", "getting started", "quickstart", "requirement"),
    "usage": ("usage", "how to", "tutorial", "guide"),
    "examples": ("example", "demo", "sample"),
    "results": ("result", "finding", "output", "performance", "evaluation"),
    "citation": ("citation", "cite", "reference", "bibtex", "bibliography"),
    "reproduction": ("reproduce", "replicat", "verify", "validat", "benchmark"),
    "overview": ("overview", "description", "about", "introduction", "abstract"),
    "api": ("api", "reference", "documentation"),
    "license": ("license", "copyright", "legal"),
    "contribution": ("contribute", "contributing", "development", "develop"),
    "requirements": ("depend", "require"),
    "data": ("data", "dataset", "corpus"),
}
# The groups under which section headings are counted; others keep their heading.
NORMAL_HEADINGS = {
    "installation": ("install", "setup", "getting started", "quickstart"),
    "usage": ("usage", "how to", "tutorial"),
    "examples": ("example", "demo"),
    "results": ("result", "output", "finding"),
    "citation": ("citation", "cite", "bibtex"),
    "license": ("license", "licence"),
    "contribution": ("contribute", "contributing"),
    "requirements": ("requirement", "depend"),
    "overview": ("overview", "description", "about"),
    "reproduction": ("reproduc", "replicat"),
}
# What a section's text holds.
SECTION_FLAGS = {
    "has_code_snippet": ("```", "python", "import", "def ", "class ", "function", "bash", "shell"),
    "has_script_reference": (".py", ".sh", ".js", ".r", "script", "run.py", "main.py"),
    "has_data_link": (".csv", ".json", ".xml", "dataset", "data/", "zenodo", "figshare", "doi"),
    "has_docker_reference": ("docker", "container", "dockerfile"),
    "has_reproducibility_terms": ("reproduc", "replicat", "verify", "validat", "benchmark"),
}
# Two words that a section of a class holds both.
INSTRUCTIONS = {"step-by-step": ("step", "follow"), "copy-paste-ready": ("copy", "paste"), "command-oriented": ("command", "run")}


def _first_group(heading: Column | str, groups: dict[str, tuple[str, ...]], other: Column) -> Column:
    return F.coalesce(*(F.when(X.has_any(heading, words), F.lit(name)) for name, words in groups.items()), other)


def section_type(heading: Column | str) -> Column:
    return _first_group(heading, SECTION_TYPES, F.lit("general"))


def all_files(artifacts: DataFrame) -> DataFrame:
    """(artifact, path, kind, size_kb, text) of every file of every list; a path in several lists is one row with its text."""
    listed = [artifacts.select(F.col("artifact_name").alias("artifact"), F.explode("repository_structure").alias("f")).select("artifact", F.coalesce("f.path", "f.name").alias("path"), F.col("f.size_kb").alias("size_kb"), F.lit(None).cast("string").alias("text"))]
    for column in ("documentation_files", "code_files", "license_files", "docker_files"):
        rows = artifacts.select(F.col("artifact_name").alias("artifact"), F.explode(column).alias("f"))
        listed.append(rows.select("artifact", F.col("f.path").alias("path"), F.lit(None).cast("double").alias("size_kb"), X.joined("f.content").alias("text")))
    every = listed[0]
    for rows in listed[1:]:
        every = every.union(rows)
    one = every.groupBy("artifact", "path").agg(F.max("size_kb").alias("size_kb"), F.max("text").alias("text"))
    return one.select("artifact", "path", P.graph_kind("path").alias("kind"), "size_kb", "text")


def sections(files: DataFrame) -> DataFrame:
    """(artifact, path, idx, level, heading, type, line_no, body): Markdown sections; a text without headings is one section."""
    lines = files.filter("kind = 'Documentation' and text is not null").select("artifact", "path", F.split("text", "\n").alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda s: s["text"].rlike(r"^#{1,6}\s+\S"))
    marked = lines.withColumn("marks", marks)
    none = F.array(F.struct(F.lit(-1).alias("line"), F.lit("").alias("text")))
    rows = marked.select("artifact", "path", "lines", F.posexplode(F.when(F.size("marks") > 0, F.col("marks")).otherwise(none)).alias("idx", "m"), "marks")
    after = F.coalesce(F.get("marks", F.col("idx") + 1)["line"], F.size("lines"))
    body = F.concat_ws("\n", F.slice("lines", F.col("m.line") + 2, F.greatest(after - F.col("m.line") - 1, F.lit(0))))
    heading = F.trim(F.regexp_replace("m.text", r"^#+\s+", ""))
    return rows.select("artifact", "path", "idx", F.length(F.regexp_extract("m.text", "^(#*)", 1)).alias("level"), heading.alias("heading"), section_type(heading).alias("type"), (F.col("m.line") + 1).alias("line_no"), body.alias("body"))


def nodes_edges(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, label, name, artifact) and (src, type, dst): artifacts, directories, files, sections and dependencies."""
    files = all_files(artifacts)
    art = lambda c="artifact": X.node_id(F.lit("Artifact"), F.col(c))
    at = lambda label, path: X.node_id(F.lit(label), F.concat_ws("/", "artifact", path))
    dirs = files.withColumn("parts", F.split(P.parent("path"), "/")).filter("parts[0] <> ''")
    dirs = dirs.select("artifact", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.concat_ws("/", F.slice("parts", F.lit(1), n)))).alias("path")).distinct()
    heads = sections(files)
    needs = files.filter("kind = 'DependencyFile' and text is not null").select("artifact", "path", F.explode(X.requirements("text")).alias("d")).select("artifact", "path", F.lower("d.name").alias("name"))
    nodes = [
        artifacts.select(art("artifact_name"), F.lit("Artifact"), "artifact_name", "artifact_name"),
        dirs.select(at("Directory", "path"), F.lit("Directory"), "path", "artifact"),
        files.select(at("File", "path"), "kind", "path", "artifact"),
        heads.select(X.node_id(F.lit("Section"), F.concat_ws("/", "artifact", "path", "idx")), F.lit("Section"), "heading", "artifact"),
        needs.select(X.node_id(F.lit("Dependency"), F.col("name")), F.lit("Dependency"), "name", F.lit(None).cast("string")).distinct(),
    ]
    up = lambda path: F.when(P.parent(path) == "", art()).otherwise(at("Directory", P.parent(path)))
    edges = [
        dirs.select(up("path"), F.lit("CONTAINS"), at("Directory", "path")),
        files.select(up("path"), F.lit("CONTAINS"), at("File", "path")),
        heads.select(at("File", "path"), F.lit("HAS_SECTION"), X.node_id(F.lit("Section"), F.concat_ws("/", "artifact", "path", "idx"))),
        needs.select(at("File", "path"), F.lit("DEPENDS_ON"), X.node_id(F.lit("Dependency"), F.col("name"))).distinct(),
        files.filter("lower(path) rlike '(^|/)readme' ").select(art(), F.lit("HAS_DOCUMENTATION"), at("File", "path")),
    ]

    def union(parts: list[DataFrame], names: list[str]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.toDF(*names)

    return union(nodes, ["id", "label", "name", "artifact"]), union(edges, ["src", "type", "dst"])


def section_patterns(heads: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most common (type, heading): artifacts, occurrences, mean length, how many have code, scripts or data."""
    low = F.lower("body")
    has = lambda test: F.count_distinct(F.when(test, F.col("artifact")))
    out = heads.groupBy("type", F.lower("heading").alias("heading")).agg(
        F.count_distinct("artifact").alias("artifacts"), F.count("*").alias("n"), F.round(F.avg(F.length("body")), 6).alias("mean_length"), has(F.contains("body", F.lit("```"))).alias("with_code"),
        has(low.rlike(r"\.(sh|py)\b")).alias("with_scripts"), has(F.contains(low, F.lit("data"))).alias("with_data"), F.slice(F.sort_array(F.collect_set("artifact")), 1, 5).alias("examples"),
    )
    return out.orderBy(F.desc("artifacts"), F.desc("n"), "type", "heading").limit(k)


def enriched(heads: DataFrame) -> DataFrame:
    """Sections with what their texts hold: content_length, normalized, the five flags, and how they instruct; sections without a text are left out."""
    low, size = F.lower("body"), F.length("body")
    both = {name: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b)) for name, (a, b) in INSTRUCTIONS.items()}
    how = F.coalesce(*(F.when(c, F.lit(name)) for name, c in both.items()), F.when(size > 200, "detailed").when(size > 50, "moderate").otherwise("brief"))
    return heads.filter("body is not null").withColumns({"content_length": size, "normalized": _first_group("heading", NORMAL_HEADINGS, F.col("heading")), **{k: X.has_any("body", words) for k, words in SECTION_FLAGS.items()}, "instruction": how})


def _some(test: Column | str) -> Column:
    """Whether one section of the group is so."""
    return F.coalesce(F.bool_or(F.col(test) if isinstance(test, str) else test), F.lit(False))


def _headed(name: str) -> Column:
    return _some(F.col("normalized") == name)


def readme_quality(sections: DataFrame) -> DataFrame:
    """(artifact, path, score, grade, instruction, n_sections): a README's points, at most 100, from ``enriched`` sections."""
    # Points of what a README has, and least raw points of each grade.
    heads = {"installation": 20, "usage": 15, "examples": 10, "results": 10, "citation": 5}
    flags = {"has_code_snippet": 15, "has_script_reference": 10, "has_data_link": 5, "has_docker_reference": 5, "has_reproducibility_terms": 5}
    grades = {"A": 90, "B": 80, "C": 70, "D": 60}
    total = F.sum("content_length")
    points = [(_headed(k), p) for k, p in heads.items()] + [(_some(k), p) for k, p in flags.items()]
    raw = sum((F.when(c, p).otherwise(0) for c, p in points), F.when(total > 1000, 10).otherwise(F.floor(total / 100))).cast("int")
    high = _some(F.col("instruction").isin("step-by-step", "copy-paste-ready"))
    how = F.when(high, "high").when(F.avg("content_length") > 200, "medium").otherwise("low")
    rows = sections.groupBy("artifact", "path").agg(raw.alias("raw"), how.alias("instruction"), F.count("*").alias("n_sections"))
    grade = F.coalesce(*(F.when(F.col("raw") >= least, F.lit(g)) for g, least in grades.items()), F.lit("F"))
    return rows.select("artifact", "path", F.least("raw", F.lit(100)).alias("score"), grade.alias("grade"), "instruction", "n_sections")


def archetypes(sections: DataFrame) -> DataFrame:
    """(archetype, n, sections, structured, reproducibility): READMEs by their leading purpose, with mean numbers of sections."""
    named = {k: _headed(k) for k in ("installation", "usage", "examples", "results", "reproduction")}
    flags = {k: _some(f) for k, f in (("code", "has_code_snippet"), ("script", "has_script_reference"), ("data", "has_data_link"))}
    structured = F.count_if(F.col("normalized").isin(*named))
    per = sections.groupBy("artifact", "path").agg(*(c.alias(k) for k, c in (named | flags).items()), F.count("*").alias("total"), structured.alias("structured"), F.count_if("has_reproducibility_terms").alias("terms"))
    kind = (
        F.when(F.col("reproduction") & F.col("results") & F.col("script"), "replication-heavy").when(F.col("examples") & F.col("usage") & F.col("code"), "tutorial").when(F.col("results") & F.col("data"), "benchmark")
        .when(F.col("total") <= 3, "summary-only").when(F.col("usage") & F.col("installation"), "standard").otherwise("other")
    )
    return per.groupBy(kind.alias("archetype")).agg(F.count("*").alias("n"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("total", "sections"), ("structured", "structured"), ("terms", "reproducibility"))))


#: The five motifs of READMEs, as tests of a section.
MOTIFS = {
    "installation": lambda: F.col("normalized") == "installation",
    "docker": lambda: F.col("has_docker_reference"),
    "citation-zenodo": lambda: (F.col("normalized") == "citation") & F.col("has_data_link"),
    "results": lambda: F.col("normalized") == "results",
    "reproduction": lambda: F.col("has_reproducibility_terms"),
}


def motifs(sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(artifact, motifs): the README motifs that hold, for each artifact of ``docs``."""
    found = F.array_compact(F.array(*(F.when(_some(test()), F.lit(k)) for k, test in MOTIFS.items())))
    per = sections.groupBy("artifact").agg(found.alias("motifs"))
    return docs.select("artifact").distinct().join(per, "artifact", "left").select("artifact", F.coalesce("motifs", F.array().cast("array<string>")).alias("motifs"))


def motif_strengths(sections: DataFrame, of: int = 20) -> DataFrame:
    """(motif, artifacts, occurrences, mean_length, strength, strong): sections of successful artifacts by motif; ``of`` artifacts are strength 100."""
    held = F.explode(F.array_compact(F.array(*(F.when(test(), F.lit(k)) for k, test in MOTIFS.items())))).alias("motif")
    rows = sections.select("artifact", "content_length", held).groupBy("motif")
    strength = F.count_distinct("artifact") / of * 100
    return rows.agg(F.count_distinct("artifact").alias("artifacts"), F.count("*").alias("occurrences"), F.round(F.avg("content_length"), 6).alias("mean_length"), F.round(strength, 6).alias("strength"), (strength > 50).alias("strong"))


def composite_motifs(found: DataFrame, scores: DataFrame, most: int = 10) -> DataFrame:
    """(artifact, score, motif_count, pattern): artifacts of at least two motifs, from ``motifs`` and (artifact, score); most motifs first."""
    rows = found.filter(F.size("motifs") >= 2).join(scores, "artifact")
    out = rows.select("artifact", "score", F.size("motifs").alias("motif_count"), F.concat_ws(" + ", "motifs").alias("pattern"))
    return out.orderBy(F.desc("motif_count"), F.desc("score"), "artifact").limit(most)
