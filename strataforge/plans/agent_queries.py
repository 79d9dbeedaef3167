"""One query for every component and agent of the rule agents, over artifacts dealt from ``documents``.

The SQL states each predicate as the survey words it, over rows of the artifact's
entries (n), documents (t), code files (k) and licenses (h); it shares the stand-in
rows with the queries and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agents as A
from . import standins as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _values(items) -> str:
    return ", ".join("(" + str(i) + ", '" + x.replace("'", "''") + "')" for i, x in enumerate(items))


_BASE = f"""
paths(i, path) AS (VALUES {_values(D.PATHS)}), phrases(i, line) AS (VALUES {_values(D.PHRASES)}), lines(i, line) AS (VALUES {_values(D.CODE_LINES)}),
licenses(i, line) AS (VALUES {_values(D.LICENSES)}), urls(i, url) AS (VALUES {_values(D.URLS)}),
a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE source END AS repository, CASE WHEN doc_id % 11 <> 0 THEN url END AS url FROM documents LEFT JOIN urls ON i = doc_id % {len(D.URLS)}),
n AS (SELECT doc_id, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '[^/]*$')) AS f, lower(path) AS p FROM documents JOIN paths ON (doc_id * (i + 3) + i) % 97 < 13),
said AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE (doc_id * (i + 2) + i) % 97 < 5) AS m, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE (doc_id * (i + 5) + i) % 97 < 4) AS g FROM documents, phrases GROUP BY doc_id),
t0 AS (SELECT doc_id, 0 AS o, 'docs/guide.md' AS path, coalesce(g, '') AS c FROM said WHERE doc_id % 3 = 0
  UNION ALL SELECT d.doc_id, 1, 'README.md', concat_ws(chr(10), m, coalesce(text, '')) FROM documents d JOIN said USING (doc_id) WHERE d.doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 2, 'docs/Readme.txt', coalesce(g, '') FROM said WHERE doc_id % 5 = 0),
t AS (SELECT doc_id, contains(lower(path), 'readme') AS readme, contains(lower(path), 'readme') AND row_number() OVER (PARTITION BY doc_id, contains(lower(path), 'readme') ORDER BY o) = 1 AS main, c, lower(c) AS l FROM t0),
k0 AS (SELECT doc_id, j, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE (doc_id + j * 5 + i * 3) % 11 = 0) AS c FROM documents, lines, range(4) r(j) WHERE j < doc_id % 5 GROUP BY ALL),
k AS (SELECT doc_id, coalesce(c, '') AS c, lower(coalesce(c, '')) AS l FROM k0),
h AS (SELECT doc_id, lower(line) AS l FROM documents JOIN licenses ON i = doc_id % {len(D.LICENSES)} OR (doc_id % 2 = 1 AND i = (doc_id + 3) % {len(D.LICENSES)}) WHERE doc_id % 3 = 1)"""

#: SQL of each predicate over the rows of one artifact.
_PREDICATES = {
    "any_docs": ("t", r"""bool_or(true)"""),
    "config_files": ("n", r"""bool_or(regexp_matches(f, 'config|env|environment|settings'))"""),
    "example_files": ("n", r"""bool_or(regexp_matches(f, 'example|demo|tutorial|notebook'))"""),
    "has_readme": ("t", r"""bool_or(readme)"""),
    "license_file": ("h", r"""bool_or(true)"""),
    "license_open": ("h", r"""bool_or(regexp_matches(l, 'mit license|apache license|gpl|bsd license|creative commons|cc-by|cc0|public domain|mozilla public license|eclipse public license'))"""),
    "main_file": ("n", r"""bool_or(f IN ('main.py', 'app.py', 'run.py', 'start.py', 'index.py'))"""),
    "pre02": ("t", r"""bool_or(contains(c, 'doi.org') OR contains(c, '10.'))"""),
    "pre04": ("t", r"""bool_or(readme AND contains(l, 'license'))"""),
    "pre06": ("t", r"""bool_or(main AND (contains(c, '```') OR regexp_matches(c, '(?m)^\s+[a-zA-Z]')))"""),
    "pre07": ("t", r"""bool_or(main AND regexp_matches(c, '(?m)^#{1,6}\s+|^[\s]*[-*+]\s+|\[.*\]\(.*\)'))"""),
    "pre08": ("t", r"""bool_or(readme AND regexp_matches(l, 'setup|install|installation|requirements|dependencies|prerequisites|environment|configuration'))"""),
    "pre09": ("t", r"""bool_or(readme AND regexp_matches(l, 'usage|how to use|examples|commands|run|execute|quick start|getting started'))"""),
    "pre10": ("n", r"""bool_or(f IN ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml'))"""),
    "pre11": ("n", r"""bool_or(f IN ('requirements.txt', 'package.json', 'pom.xml', 'build.gradle', 'cargo.toml'))"""),
    "pre12": ("n", r"""bool_or(f IN ('main.py', 'app.py', 'run.py', 'cli.py') OR f LIKE '%.sh')"""),
    "pre13": ("t", r"""bool_or(regexp_matches(l, 'reproduce|replicate|results|experiments|evaluation|benchmark|performance|metrics'))"""),
    "pre14": ("n", r"""bool_or(regexp_matches(f, 'api|docs'))"""),
    "pre15": ("t", r"""bool_or(regexp_matches(l, 'architecture|design|structure|overview|system'))"""),
    "pre16": ("t", r"""bool_or(regexp_matches(l, 'troubleshooting|faq|issues|problems|debug'))"""),
    "pre17": ("n", r"""bool_or(regexp_matches(f, 'contributing|contribute'))"""),
    "pre18": ("t", r"""bool_or(regexp_matches(l, 'hardware|cpu|gpu|memory|ram|storage|disk space|processor|cores|threads|minimum requirements'))"""),
    "pre19": ("t", r"""bool_or(regexp_matches(l, 'software|operating system|os|python|java|c\+\+|dependencies|libraries|packages|frameworks|version|requirements'))"""),
    "pre20": ("n", r"""bool_or(f IN ('requirements.txt', 'package.json', 'pom.xml', 'build.gradle', 'cargo.toml', 'go.mod', 'environment.yml'))"""),
    "pre21": ("n", r"""bool_or(regexp_matches(f, '\.(csv|json|tsv|xlsx|xls|parquet|h5|hdf5)$') OR contains(p, '/data/') OR contains(p, '/dataset/') OR contains(p, '/datasets/') OR contains(p, 'data/') OR contains(p, 'dataset/'))"""),
    "pre22": ("t", r"""bool_or(regexp_matches(l, 'dataset|data|format|schema|columns|fields|attributes|data description|data format|data structure'))"""),
    "pre23": ("t", r"""bool_or(regexp_matches(c, 'https?://') OR contains(l, 'dataset'))"""),
    "pre24": ("n", r"""bool_or(regexp_matches(f, 'preprocess|clean|transform|prepare'))"""),
    "pre25": ("n", r"""bool_or(contains(f, 'test'))"""),
    "pre26": ("n", r"""bool_or(regexp_matches(f, 'eval|evaluate|benchmark|metrics|performance'))"""),
    "pre27": ("t", r"""bool_or(regexp_matches(l, 'results|performance|metrics|accuracy|precision|recall|f1|benchmark|evaluation|comparison'))"""),
    "pre28": ("t", r"""bool_or(regexp_matches(l, 'validation|verification|testing|quality assurance|qa|correctness|reliability'))"""),
    "pre30": ("n", r"""bool_or(regexp_matches(f, '(\.txt|\.md|\.pdf|\.csv|\.json|\.xml|\.yaml|\.yml|\.zip|\.tar\.gz|\.py|\.ipynb)$'))"""),
    "pre33": ("k", r"""bool_or(regexp_matches(c, '(?m)^import\s+|^from\s+.*\s+import'))"""),
    "pre34": ("n", r"""bool_or(regexp_matches(f, 'config|settings|env|ini|yaml|yml|json'))"""),
    "pre35": ("k", r"""bool_or(regexp_matches(c, '(?i)try\s*:|except\s*:|catch\s*\(|finally\s*:|raise\s+|throw\s+|error|exception'))"""),
    "pre38": ("n", r"""bool_or(contains(f, 'test') OR contains(p, 'test'))"""),
    "pre39": ("n", r"""bool_or(regexp_matches(f, 'validate|validation|verify|verification'))"""),
    "pre40": ("t", r"""bool_or(regexp_matches(l, 'verify|verification|validate|validation|test|testing|quality|assurance|correctness|reliability'))"""),
    "pre41": ("n", r"""bool_or(regexp_matches(f, 'lint|flake8|pylint|eslint|checkstyle'))"""),
    "pre42": ("n", r"""bool_or(regexp_matches(f, 'benchmark|performance|speed|timing'))"""),
    "pre43": ("n", r"""bool_or(f IN ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml'))"""),
    "pre44": ("n", r"""bool_or(regexp_matches(f, 'setup\.py|install|package|dist|build'))"""),
    "pre45": ("n", r"""bool_or(regexp_matches(f, 'venv|env|virtualenv|conda|environment\.yml'))"""),
    "pre46": ("n", r"""bool_or(regexp_matches(f, 'build|make|compile|install\.sh|setup\.sh'))"""),
    "pre47": ("t", r"""bool_or(regexp_matches(l, 'deploy|deployment|production|server|hosting|install|setup|configuration'))"""),
    "pre49": ("n", r"""bool_or(regexp_matches(f, 'config|settings|params|parameters'))"""),
    "pre50": ("k", r"""bool_or(regexp_matches(c, 'def\s+[\pL\pN_]+\s*\([^)]*\)|class\s+[\pL\pN_]+\s*\([^)]*\)|args\.|kwargs\.|config\[|settings\['))"""),
    "pre51": ("t", r"""bool_or(regexp_matches(l, 'reuse|reusable|modular|component|library|api|interface|extend|customize|configure'))"""),
    "pre52": ("k", r'''bool_or(regexp_matches(c, 'def\s+[\pL\pN_]+\s*\([^)]*\):\s*"""[^"]*"""|class\s+[\pL\pN_]+\s*\([^)]*\):\s*"""[^"]*"""|@property|@staticmethod|@classmethod'))'''),
    "pre53": ("t", r"""bool_or(regexp_matches(l, '(?i)\d+\.\s+|[-*]\s+|step\s+\d+|first\s+|second\s+|third\s+'))"""),
    "pre54": ("t", r"""bool_or(regexp_matches(l, 'environment|virtual|venv|conda|docker|container|python|java|node|npm|pip|install'))"""),
    "pre55": ("t", r"""bool_or(regexp_matches(l, 'install|dependency|requirement|package|library|pip install|npm install|maven|gradle'))"""),
    "pre56": ("t", r"""bool_or(regexp_matches(l, 'troubleshoot|troubleshooting|faq|common issues|problems|errors|debug|fix'))"""),
    "pre57": ("t", r"""bool_or(regexp_matches(l, 'verify|test|check|validate|confirm|run test|hello world|example|demo'))"""),
    "pre58": ("t", r"""bool_or(regexp_matches(l, 'example|usage|how to|basic|simple|quick start|getting started|demo|tutorial'))"""),
    "pre59": ("t", r"""bool_or(regexp_matches(c, 'python\s+[\pL\pN_]+\.py|java\s+[\pL\pN_]+|node\s+[\pL\pN_]+|\./[\pL\pN_-]+|bash\s+[\pL\pN_-]+|curl\s+'))"""),
    "pre60": ("t", r"""bool_or(regexp_matches(l, 'parameter|argument|option|flag|--|-|input|output|config|setting'))"""),
    "pre61": ("t", r"""bool_or(regexp_matches(l, 'output|result|example|sample|expected|should see|will produce|generates'))"""),
    "pre62": ("t", r"""bool_or(regexp_matches(l, 'use case|scenario|example|case study|application|workflow|pipeline|process'))"""),
    "pre63": ("t", r"""bool_or(regexp_matches(l, 'reproduce|replicate|results|experiments|evaluation|benchmark|performance|metrics|paper results'))"""),
    "pre64": ("t", r"""bool_or(regexp_matches(l, 'expected|should|will|output|result|accuracy|precision|recall|f1|performance'))"""),
    "pre65": ("n", r"""bool_or(regexp_matches(f, 'benchmark|performance|speed|timing|eval'))"""),
    "pre66": ("n", r"""bool_or(regexp_matches(f, 'validate|validation|verify|test|check'))"""),
    "pre67": ("t", r"""bool_or(regexp_matches(l, 'paper|publication|table|figure|comparison|baseline|state-of-the-art|sota|previous work'))"""),
    "pre68": ("t", r"""bool_or(regexp_matches(l, 'intuitive|easy to use|user-friendly|simple|straightforward|clear|obvious|self-explanatory|logical'))"""),
    "pre69": ("t", r"""bool_or(regexp_matches(l, 'basic|advanced|beginner|expert|simple|complex|step by step|progressive|tutorial|guide'))"""),
    "pre70": ("t", r"""bool_or(regexp_matches(l, 'guide|tutorial|help|assistance|support|walkthrough|how to|instructions|manual|guidebook'))"""),
    "pre72": ("t", r"""bool_or(regexp_matches(l, 'accessibility|accessible|screen reader|keyboard navigation|high contrast|font size|color blind|disability'))"""),
    "pre73": ("n", r"""bool_or(regexp_matches(f, 'html|css|js|web|app|server'))"""),
    "pre74": ("n", r"""bool_or(regexp_matches(f, 'cli|command|shell|script|main\.py'))"""),
    "pre75": ("n", r"""bool_or(regexp_matches(f, 'gui|tkinter|pyqt|wx|gtk|ui'))"""),
    "pre76": ("n", r"""bool_or(regexp_matches(f, 'interactive|notebook|jupyter|demo|playground'))"""),
    "pre77": ("n", r"""bool_or(regexp_matches(f, 'responsive|mobile|adaptive|flexible'))"""),
    "pre78": ("k", r"""bool_or(regexp_matches(c, '(?i)try\s*:|except\s*:|catch\s*\(|finally\s*:|raise\s+|throw\s+|error|exception'))"""),
    "pre79": ("k", r"""bool_or(regexp_matches(c, '(?i)print\s*\([^)]*error[^)]*\)|logging\.[^)]*error[^)]*\)|raise\s+[^)]*Error[^)]*\)|return\s+[^)]*error[^)]*\)'))"""),
    "pre80": ("k", r"""bool_or(regexp_matches(l, 'validate|validation|check|verify|confirm|feedback|message|notification|alert'))"""),
    "pre81": ("k", r"""bool_or(regexp_matches(l, 'recover|restore|backup|retry|fallback|alternative|default|safe|secure'))"""),
    "pre82": ("n", r"""bool_or(f IN ('.git', '.gitignore', '.gitattributes'))"""),
    "pre83": ("n", r"""bool_or(regexp_matches(f, 'changelog|version|history|log'))"""),
    "pre84": ("n", r"""bool_or(regexp_matches(f, 'feedback|issue|bug|report|contact'))"""),
    "pre85": ("t", r"""bool_or(regexp_matches(l, 'update|version|changelog|history|revision|latest|current|new|improved'))"""),
    "pre86": ("n", r"""bool_or(regexp_matches(f, 'issue|bug|tracker|todo|fixme'))"""),
    "provenance": ("t", r"""bool_or(main AND regexp_matches(l, 'provenance|citation|reference|paper'))"""),
    "purpose": ("t", r"""bool_or(main AND regexp_matches(l, 'purpose|description|about|overview'))"""),
    "script_files": ("n", r"""bool_or(regexp_matches(f, '\.(sh|bat|py|js)$'))"""),
    "setup_files": ("n", r"""bool_or(regexp_matches(f, 'setup|install|requirements|dockerfile'))"""),
    "setup_section": ("t", r"""bool_or(main AND regexp_matches(l, 'setup|install|installation|requirements'))"""),
    "usage_section": ("t", r"""bool_or(main AND regexp_matches(l, 'usage|how to use|examples|commands'))"""),
    "pre29": ("n", r"""count(*) >= 5 AND bool_or(contains(f, 'readme')) AND bool_or(regexp_matches(name, '\.(py|java|cpp|js)$'))"""),
    "pre31": ("t", r"""count(*) >= 2 AND bool_or(readme)"""),
    "two_docs": ("t", r"""count(*) >= 2"""),
    "three_code": ("k", r"""count(*) >= 3"""),
    "ten_entries": ("n", r"""count(*) >= 10"""),
    "pre37": ("n", r"""bool_or(contains(p, 'src'))::INT + bool_or(contains(p, 'doc'))::INT + bool_or(contains(p, 'test'))::INT >= 2"""),
    "snake": ("n", "bool_or(contains(name, '_'))"),
    "kebab": ("n", "bool_or(contains(name, '-'))"),
    "camel": ("n", "bool_or(regexp_matches(name, '[a-z][A-Z]'))"),
    "version_file": ("n", "bool_or(f IN ('version', 'version.txt', 'changelog', 'changelog.md'))"),
    "version_text": ("t", "bool_or(contains(l, 'version') OR contains(l, 'changelog'))"),
    "modules": ("n", "bool_or(contains(p, 'module') OR contains(name, '__init__.py'))"),
    "many_code": ("k", "count(*) > 3"),
    "doi_text": ("t", "bool_or(contains(c, 'doi.org') OR contains(c, '10.'))"),
}

#: Predicates of an artifact's own columns and of other predicates: (SQL, what it needs).
_STYLES = ("snake::INT + kebab::INT + camel::INT <= 2", ("snake", "kebab", "camel"))
_COMBINED = {
    "has_name": ("coalesce(repository, '') <> ''", ()),
    "has_url": ("coalesce(url, '') <> ''", ()),
    "url_valid": ("regexp_matches(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://[^/?#]+')", ()),
    "archive_host": (r"regexp_matches(lower(coalesce(url, '')), 'zenodo|figshare|dataverse|dryad|osf\.io')", ()),
    "code_host": (r"NOT archive_host AND regexp_matches(lower(coalesce(url, '')), 'github\.com|gitlab\.com|bitbucket\.org')", ("archive_host",)),
    "other_host": ("NOT archive_host AND NOT code_host", ("code_host",)),
    "license_closed": ("license_file AND NOT license_open", ("license_file", "license_open")),
    "pre02": ("doi_text OR contains(coalesce(url, ''), 'doi.org') OR contains(coalesce(url, ''), '10.')", ("doi_text",)),
    "pre32": ("version_file OR version_text", ("version_file", "version_text")),
    "pre36": _STYLES,
    "pre71": _STYLES,
    "pre48": ("modules OR many_code", ("modules", "many_code")),
}

#: Weights as the survey's rows COM02 to COM29 give them, by agent.
_AGENTS = {
    ("com01", "accessibility"): {
        ("com02", "availability"): "has_name .3 has_url .4 url_valid .3",
        ("com03", "archival"): "archive_host 1 code_host .5 other_host .3 pre02 .2",
        ("com04", "licensing"): "license_file .4 license_open .4 license_closed .2 pre04 .2",
    },
    ("com05", "documentation"): {
        ("com06", "readme"): "has_readme .2 purpose .2 provenance .2 setup_section .2 usage_section .2 pre06 .1 pre07 .1",
        ("com07", "setup_instructions"): "pre08 .4 setup_files .3 pre10 .2 pre11 .1",
        ("com08", "usage_instructions"): "pre09 .3 example_files .3 pre12 .2 pre13 .2",
        ("com09", "comprehensive"): "any_docs .2 pre14 .2 pre15 .2 pre16 .2 pre17 .2",
    },
    ("com10", "experimental"): {
        ("com11", "experimental_setup"): "pre18 .3 pre19 .3 config_files .2 pre20 .2",
        ("com12", "data_availability"): "pre21 .4 pre22 .3 pre23 .2 pre24 .1",
        ("com13", "validation_evidence"): "pre25 .3 pre26 .3 pre27 .2 pre28 .2",
        ("com14", "artifact_packaging"): "pre29 .3 pre30 .3 pre31 .2 pre32 .2",
    },
    ("com15", "functionality"): {
        ("com16", "executability"): "main_file .3 script_files .2 pre33 .2 pre34 .1 pre35 .2",
        ("com17", "consistency"): "ten_entries .2 pre36 .2 two_docs .2 three_code .2 pre37 .2",
        ("com18", "verification"): "pre38 .3 pre39 .2 pre40 .2 pre41 .2 pre42 .1",
        ("com19", "preparation"): "pre43 .3 pre44 .2 pre45 .2 pre46 .2 pre47 .1",
    },
    ("com20", "reproducibility"): {
        ("com21", "reusability"): "pre48 .3 pre49 .2 pre50 .2 pre51 .2 pre52 .1",
        ("com22", "setup_clarity"): "pre53 .3 pre54 .2 pre55 .2 pre56 .2 pre57 .1",
        ("com23", "usage_clarity"): "pre58 .3 pre59 .2 pre60 .2 pre61 .2 pre62 .1",
        ("com24", "result_replication"): "pre63 .3 pre64 .2 pre65 .2 pre66 .2 pre67 .1",
    },
    ("com25", "usability"): {
        ("com26", "user_experience"): "pre68 .3 pre69 .2 pre70 .2 pre71 .2 pre72 .1",
        ("com27", "user_interface"): "pre73 .3 pre74 .2 pre75 .2 pre76 .2 pre77 .1",
        ("com28", "error_handling"): "pre78 .3 pre79 .3 pre80 .2 pre81 .2",
        ("com29", "review_process"): "pre82 .3 pre83 .2 pre84 .2 pre85 .2 pre86 .1",
    },
}


def _weighted(spec: str) -> list[tuple[str, str]]:
    words = spec.split()
    return list(zip(words[::2], words[1::2], strict=True))


def _flags_sql(names: list[str]) -> str:
    """CTEs up to ``x``: one row per artifact with the named predicates."""
    plain, combined = [], []

    def need(name: str) -> None:
        if name in _COMBINED:
            for other in _COMBINED[name][1]:
                need(other)
            if name not in combined:
                combined.append(name)
        elif name not in plain:
            plain.append(name)

    for name in names:
        need(name)
    sources = [s for s in "ntkh" if any(_PREDICATES[p][0] == s for p in plain)]
    ctes = [f"{s}s AS (SELECT doc_id, " + ", ".join(f"{_PREDICATES[p][1]} AS {p}" for p in plain if _PREDICATES[p][0] == s) + f" FROM {s} GROUP BY doc_id)" for s in sources]
    joins = " ".join(f"LEFT JOIN {s}s USING (doc_id)" for s in sources)
    ctes.append("x0 AS (SELECT a.doc_id, repository, url" + "".join(f", coalesce({p}, false) AS {p}" for p in plain) + f" FROM a {joins})")
    for k, name in enumerate(combined):
        ctes.append(f"x{k + 1} AS (SELECT *, {_COMBINED[name][0]} AS {name} FROM x{k})")
    return f"WITH {_BASE.strip()},\n" + ",\n".join(ctes) + f",\nx AS (SELECT * FROM x{len(combined)})\n"


def _sum_sql(spec: str) -> str:
    return "least(1::DOUBLE, 0::DOUBLE + " + " + ".join(f"CASE WHEN {p} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in _weighted(spec)) + ")"


def _component_query(dimension: str, component: str) -> Query:
    return lambda spark, sf: A.component(D.artifacts(spark, sf), dimension, component)


def _agent_query(dimension: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return A.agent_scores(A.component_scores(D.artifacts(spark, sf), (dimension,))).select("artifact_name", "score", "justification")

    return run


for (_number, _dimension), _parts in _AGENTS.items():
    for (_com, _component), _spec in _parts.items():
        _names = [p for p, _ in _weighted(_spec)]
        QUERIES[f"{_com}_{_component}"] = _component_query(_dimension, _component)
        ORACLES[f"{_com}_{_component}"] = _flags_sql(_names) + "SELECT doc_id::VARCHAR AS artifact_name, " + _sum_sql(_spec) + " AS score, " + ", ".join(_names) + " FROM x"
    _all = [p for _spec in _parts.values() for p, _ in _weighted(_spec)]
    _cs = [f"{_sum_sql(_spec)} AS c{k}" for k, _spec in enumerate(_parts.values())]
    _mean = "(" + " + ".join(f"c{k}" for k in range(len(_parts))) + f") / {len(_parts)}"
    _low = "least(c0, c1, c2)"  # the wording speaks of the first three
    QUERIES[f"{_number}_{_dimension}_agent"] = _agent_query(_dimension)
    ORACLES[f"{_number}_{_dimension}_agent"] = (
        _flags_sql(_all) + f", y AS (SELECT doc_id, {', '.join(_cs)} FROM x)\nSELECT doc_id::VARCHAR AS artifact_name, round({_mean}, 6) AS score, "
        f"CASE WHEN {_low} >= 0.8::DOUBLE THEN 'excellent' WHEN {_low} >= 0.6::DOUBLE THEN 'good' WHEN {_low} >= 0.4::DOUBLE THEN 'fair' ELSE 'poor' END || ' {_dimension}' AS justification FROM y"
    )
