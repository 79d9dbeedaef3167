"""Retrieval and generation: strategies, section contexts, prompts, replaceable providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import similarity as V

# Focus labels, focus edges and weights (vector, graph) of each section; others look at all.
STRATEGIES = {
    "title_purpose": (("Artifact", "Section"), ("DESCRIBES",), 0.7, 0.3),
    "setup": (("Dependency", "Command", "Tool"), ("DEPENDS_ON", "REQUIRES"), 0.5, 0.5),
    "usage": (("Command", "File"), ("GENERATES", "PRODUCES"), 0.4, 0.6),
    "outputs": (("Output", "Dataset"), ("GENERATES", "PRODUCES"), 0.6, 0.4),
    "structure": (("Section",), ("CONTAINS", "PART_OF"), 0.3, 0.7),
}
DEFAULT = ((), (), 0.5, 0.5)
CONTEXT_CHARS, NODE_CHARS = 4000, 500


def node_text(label: Column | str, name: Column | str, body: Column | str) -> Column:
    """Labelled lines of a node, the body cut for prompts."""
    return F.concat_ws("\n", F.concat(F.lit("Type: "), label), F.concat(F.lit("Name: "), name), F.concat(F.lit("Content: "), F.substring(body, 1, NODE_CHARS)))


def graph_hits(edges: DataFrame, nodes: DataFrame, section: str, k: int) -> DataFrame:
    """(key, score): nodes of the section's focus labels by their number of focus edges."""
    labels, types = STRATEGIES.get(section, DEFAULT)[:2]
    edges = edges.filter(F.col("type").isin(*types)) if types else edges
    rows = nodes.filter(F.col("label").isin(*labels)) if labels else nodes
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return rows.join(ends, "id").groupBy(F.col("id").alias("key")).agg(F.count("*").cast("double").alias("score")).orderBy(F.desc("score"), "key").limit(k)


def retrieve(section: str, vector_hits: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(key, score): both result lists, scaled to their best and weighted by the section's strategy."""
    by_vector, by_graph = STRATEGIES.get(section, DEFAULT)[2:]
    best = hits.agg(F.max("score").alias("best"))
    scaled = hits.join(F.broadcast(best)).select("key", F.try_divide(F.col("score"), F.col("best")).alias("score"))  # one row
    return V.merged(vector_hits, scaled, by_vector, by_graph, k)


def section_context(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(artifact, context): per label the first ``most`` names, as a map."""
    per = nodes.groupBy("artifact", "label").agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("names"))
    return per.groupBy("artifact").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "names")))).alias("context"))


def prompts(contexts: DataFrame, template: str) -> DataFrame:
    """(artifact, prompt): the template's ``{artifact}`` and ``{context}`` filled in."""
    text = F.substring(F.to_json("context"), 1, CONTEXT_CHARS)
    filled = F.replace(F.replace(F.lit(template), F.lit("{artifact}"), F.col("artifact")), F.lit("{context}"), text)
    return contexts.select("artifact", filled.alias("prompt"))


def generated(rows: DataFrame, provider: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(artifact, text): a provider's reply to each prompt, a placeholder where it fails; without one the prompt itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asked = part["prompt"].tolist()
            try:
                text = provider(asked) if provider else asked
            except Exception as e:  # noqa: BLE001  an edge: any provider may fail
                text = [f"[not generated: {type(e).__name__}]"] * len(asked)
            yield pd.DataFrame({"artifact": part["artifact"], "text": text})

    return rows.mapInPandas(run, "artifact string, text string")


def reply(text: Column | str) -> Column:
    """A provider's JSON reply as struct<score, justification>; null where it is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "struct<score:double,justification:string>")
