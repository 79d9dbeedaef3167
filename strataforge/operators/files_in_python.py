"""Per-artifact operators that need an order or a parser: near-duplicate files, syntax facts, tree rendering.

Each artifact's files are one group; an artifact is bounded by the reader's limits
(``sources.readers``), unlike a corpus, whose near duplicates are another operator's.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "artifact string, path string, kind string, name string, line int"


def distinct_files(files: DataFrame, least: float = 0.9) -> DataFrame:
    """(artifact, path): files in order of path, less those whose text is at least ``least`` like one kept before.

    A pair is compared only if its lengths allow the ratio.
    """

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, str]] = []
        for path, text in sorted(zip(group["path"], group["text"].fillna(""), strict=True)):
            for _, other in kept:
                if 2 * min(len(text), len(other)) < least * (len(text) + len(other)):
                    continue
                match = SequenceMatcher(None, other, text, autojunk=False)
                if text == other or (match.quick_ratio() >= least and match.ratio() >= least):
                    break
            else:
                kept.append((path, text))
        return pd.DataFrame({"artifact": group["artifact"].iloc[0], "path": [p for p, _ in kept]})

    return files.select("artifact", "path", "text").groupBy("artifact").applyInPandas(keep, "artifact string, path string")


def syntax_facts(files: DataFrame) -> DataFrame:
    """(artifact, path, kind, name, line): functions, classes and imports of Python files; one that does not parse has none."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for artifact, path, text in zip(part["artifact"], part["path"], part["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.FunctionDef):
                        rows.append((artifact, path, "Function", node.name, node.lineno))
                    elif isinstance(node, ast.ClassDef):
                        rows.append((artifact, path, "Class", node.name, node.lineno))
                    elif isinstance(node, ast.Import):
                        rows += [(artifact, path, "Import", a.name, node.lineno) for a in node.names]
                    elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                        rows.append((artifact, path, "Import", node.module, node.lineno))
            yield pd.DataFrame(rows, columns=["artifact", "path", "kind", "name", "line"])

    return files.filter("lower(path) like '%.py'").select("artifact", "path", "text").mapInPandas(read, FACTS)


def rendered_tree(files: DataFrame) -> DataFrame:
    """(artifact, tree): the paths of an artifact as an indented tree."""

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        for path in sorted(group["path"]):
            node = root
            for part in path.split("/"):
                node = node.setdefault(part, {})
        lines: list[str] = []

        def walk(node: dict, indent: str) -> None:
            for k, (name, below) in enumerate(sorted(node.items())):
                last = k == len(node) - 1
                lines.append(f"{indent}{'└── ' if last else '├── '}{name}")
                walk(below, indent + ("    " if last else "│   "))

        walk(root, "")
        return pd.DataFrame({"artifact": [group["artifact"].iloc[0]], "tree": ["\n".join(lines)]})

    return files.select("artifact", "path").groupBy("artifact").applyInPandas(draw, "artifact string, tree string")
