"""Files and directories that documentation names: one automaton an artifact, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Automata that a task keeps for texts of artifacts with the same names.
KEPT = 64


def found_in(text: str, automaton) -> dict[int, int]:
    """How often each of the automaton's words stands in a text, overlaps counted."""
    out: dict[int, int] = {}
    for _, k in automaton.iter(text):
        out[k] = out.get(k, 0) + 1
    return out


def automaton_of(names: list[str]):
    """An Aho-Corasick automaton that gives the places of ``names``; None if there is none."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, name in enumerate(names):
        made.add_word(name, k)
    made.make_automaton()
    return made if names else None


def mentions(texts: DataFrame, artifact: str, document: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(artifact, document, name, n): each name of an artifact that stands in a text of that artifact, and how often.

    ``names`` has the artifact's names; an artifact's distinct names must fit a task, as its file list does.
    A text is read once, whatever the number of names.  Null and empty names and null texts give nothing; overlapping
    occurrences count; upper and lower case differ.
    """
    held = names.filter(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(F.col(artifact).alias("__of")).agg(F.sort_array(F.collect_set(name)).alias("__names"))
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(artifact).alias("__of"), F.col(document).alias("__doc"), F.col(text).alias("__text")).join(held, "__of")
    kinds = texts.schema[artifact].dataType.simpleString(), texts.schema[document].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[str, ...], object] = {}
        for batch in batches:
            of, doc, name, n = [], [], [], []
            for i in range(batch.num_rows):
                words = tuple(batch.column(3)[i].as_py())
                if words not in made:
                    if len(made) >= KEPT:
                        made.clear()
                    made[words] = automaton_of(list(words))
                for k, count in found_in(batch.column(2)[i].as_py(), made[words]).items():
                    of.append(i), name.append(words[k]), n.append(count)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(name, pa.string()), pa.array(n, pa.int64())], names=["artifact", "document", "name", "n"])

    return rows.select("__of", "__doc", "__text", "__names").mapInArrow(scan, f"artifact {kinds[0]}, document {kinds[1]}, name string, n long")


def edges(texts: DataFrame, artifact: str, document: str, text: str, files: DataFrame, path: str) -> DataFrame:
    """(artifact, document, type, target, n): DESCRIBES to each file whose name the text holds, MENTIONS to each directory named with its slash.

    ``files`` has an artifact's paths, with folders parted by slashes.  A name that several files
    share describes each of them.  Directories are all folders on the way to a file.
    """
    named = files.filter(F.col(path).isNotNull()).select(F.col(artifact).alias("artifact"), F.col(path).alias("target"))
    parts = F.split("target", "/")
    files_ = named.select("artifact", F.lit("DESCRIBES").alias("type"), "target", F.element_at(parts, -1).alias("name"))
    folders = named.select("artifact", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("target")).distinct()
    folders = folders.filter("target <> ''").select("artifact", F.lit("MENTIONS").alias("type"), "target", F.concat("target", F.lit("/")).alias("name"))
    targets = files_.union(folders).distinct()
    hits = mentions(texts.withColumnRenamed(artifact, "artifact"), "artifact", document, text, targets, "name")
    return hits.join(targets, ["artifact", "name"]).select("artifact", "document", "type", "target", "n")


def code_references(links: DataFrame, language: Column, kind: Column, most: int = 10) -> DataFrame:
    """(language, file_type, artifact_count, total_references) of DESCRIBES edges: most artifacts first."""
    rows = links.filter("type = 'DESCRIBES'").withColumn("language", language).withColumn("file_type", kind)
    counted = rows.groupBy("language", "file_type").agg(F.count_distinct("artifact").alias("artifact_count"), F.count("*").alias("total_references"))
    return counted.orderBy(F.desc("artifact_count"), F.desc("total_references"), "language", "file_type").limit(most)


def directory_references(links: DataFrame, most: int = 15) -> DataFrame:
    """(directory_name, artifact_count, total_mentions) of MENTIONS edges: most artifacts first."""
    rows = links.filter("type = 'MENTIONS'").groupBy(F.col("target").alias("directory_name"))
    counted = rows.agg(F.count_distinct("artifact").alias("artifact_count"), F.count("*").alias("total_mentions"))
    return counted.orderBy(F.desc("artifact_count"), F.desc("total_mentions"), "directory_name").limit(most)
