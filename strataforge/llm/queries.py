"""The queries of the corpus operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, annforest, decontamination, extraction, jaccard, mixing, sharding, substring, toxicity, urlfilter, vafile, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(_table(spark, sf_dir, "documents"))


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.search(_table(spark, sf_dir, "embeddings"))


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), keep_groups=False)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_decontamination,
        op3_toxicity,
        op4_url_filter,
        op5_substring_dedup,
        op6_prefix_forest,
        op7_warc_index,
        op8_minimax_shards,
        op9_main_text,
        op10_jaccard_join,
        op11_token_alignment,
        op12_exact_top_k,
        op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op1_source_mix": mixing.ORACLE_SQL,
    "op4_url_filter": urlfilter.ORACLE_SQL,
    "op5_substring_dedup": substring.ORACLE_SQL,
    "op7_warc_index": warc.ORACLE_SQL,
    "op10_jaccard_join": jaccard.ORACLE_SQL,
    "op12_exact_top_k": vafile.ORACLE_SQL,
}
