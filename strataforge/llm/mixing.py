"""Mixing sources to target weights: sizes per source, repetition rates, seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import checked_broadcast, written

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all sizes, and the most a source is repeated.
SHARE, MOST = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) for each source of (source, size) rows.

    Targets share ``share`` of all sizes by weight.  One above ``most`` times its source
    stops there and the excess goes to the others by weight.  In order of cap per
    weight the stopped sources come first, so one running sum finds the level.
    The aggregate has one row per source and combines before its shuffle; only
    those rows meet in the single task that orders them.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = capped.withColumn("level", left / heavy)
    free = F.col("cap") / F.col("weight") > F.col("level")
    level = F.coalesce(F.max(F.when(free, F.col("level"))).over(whole), F.lit(float("inf")))
    target = F.least(F.col("cap"), F.when(F.col("cap") > 0, F.col("weight") * level).otherwise(0.0))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return levelled.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` with source_size, target and copies: floor(rate) and one more with the fraction's probability.

    The source table is broadcast if it is small by count; beyond that the join
    shuffles, and Spark splits a hot source's partition.
    """
    side = checked_broadcast(table.select(F.col("source").alias("__source"), "source_size", "target", "rate"))
    joined = docs.join(side, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.floor("rate") + (draw() < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies).drop("__source", "rate")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with the columns of ``docs`` alone.

    Null or wordless texts have size 0; a source of size 0 gives no rows.  A null
    source is a source, the last one.  The draw depends on doc_id and a fixed seed,
    so reruns agree and rows that repeat a doc_id are drawn alike.  No rows give none.
    """
    sized = docs.select("source", n_words().alias("size"))
    table = written(rates(sized, weights, share, most), "mix-rates")
    own = docs.select(F.struct("*").alias("__row"), F.col("source"), F.col("doc_id"))
    out = with_copies(own, table).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy")).select("__row.*")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every row of ``docs``."""
    narrow = written(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    table = written(rates(narrow), "mix-rates")
    out = with_copies(narrow, table)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
             [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM s WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, CASE WHEN cap > 0 THEN weight * coalesce(max(CASE WHEN cap / weight > level THEN level END) OVER (), 'inf'::DOUBLE) ELSE 0.0 END) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, d.source, r.source_size, r.target,
             floor(r.rate)::BIGINT + (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < r.rate - floor(r.rate))::BIGINT AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source, source_size, target, copies, size * copies AS taken FROM c
"""
