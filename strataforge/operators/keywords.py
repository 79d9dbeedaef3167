"""Keyword operators: TF-IDF, keyword scores, keyword sets and their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens


def terms(docs: DataFrame, doc: str, text: str, longest: int = 2) -> DataFrame:
    """(doc, term, n): how often each n-gram of up to ``longest`` words stands in each document."""
    words = tokens(text)
    grams = F.concat(*(ngrams(words, n) for n in range(1, longest + 1)))
    return docs.select(doc, F.explode(grams).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("n"))


def tfidf(counts: DataFrame, doc: str, most: float = 0.95, least: int = 1, features: int | None = None) -> DataFrame:
    """(doc, term, tfidf) from (doc, term, n): idf is ln((1+N)/(1+df))+1, each document has length 1.

    Terms in more than ``most`` of the documents, or fewer than ``least``, go; ``features``
    keeps the most frequent of the others.  The number of documents is one row
    joined by broadcast; nothing is collected.
    """
    total = counts.select(doc).distinct().agg(F.count("*").alias("docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("all"))
    kept = df.join(F.broadcast(total)).filter((F.col("df") >= least) & ((F.col("docs") == 1) | (F.col("df") <= most * F.col("docs"))))
    if features:
        kept = kept.orderBy(F.desc("all"), "term").limit(features)
    idf = F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    raw = counts.join(kept.select("term", idf.alias("idf")), "term").withColumn("raw", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return raw.select(doc, "term", F.try_divide(F.col("raw"), length).alias("tfidf"))


def keyword_scores(weights: DataFrame, seeds: DataFrame) -> DataFrame:
    """(dimension, score, n_terms, weight) from TF-IDF rows and (dimension, category, keyword) seeds.

    A dimension's score is over the distinct union of its categories' keywords.
    """
    by_term = weights.groupBy("term").agg(F.sum("tfidf").alias("tfidf"))
    union = seeds.select("dimension", F.col("keyword").alias("term")).distinct()
    dims = seeds.select("dimension").distinct()
    found = by_term.join(union, "term").groupBy("dimension").agg(F.sum("tfidf").alias("score"), F.count("*").alias("n_terms"))
    scored = dims.join(found, "dimension", "left").fillna({"score": 0.0, "n_terms": 0})
    return scored.withColumn("weight", F.coalesce(F.try_divide(F.col("score"), F.sum("score").over(Window.partitionBy())), F.lit(0.0)))


def keyword_sets(df: DataFrame, group: str, keyword: str) -> DataFrame:
    """(group, words): the distinct keywords of each group, sorted."""
    return df.groupBy(group).agg(F.sort_array(F.collect_set(keyword)).alias("words"))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, union, Jaccard) of two keyword arrays."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return shared, union, F.coalesce(F.try_divide(shared, union), F.lit(0.0))


def set_pairs(sets: DataFrame, group: str) -> DataFrame:
    """(a, b, shared, union, only_a, only_b, jaccard) of every two groups; the groups are few (venues, sources)."""
    x, y = sets.alias("x"), sets.alias("y")
    pairs = x.join(y, F.col(f"x.{group}") < F.col(f"y.{group}"))
    shared, union, jaccard = overlap(F.col("x.words"), F.col("y.words"))
    return pairs.select(
        F.col(f"x.{group}").alias("a"), F.col(f"y.{group}").alias("b"), shared.alias("shared"), union.alias("union"),
        F.size(F.array_except("x.words", "y.words")).alias("only_a"), F.size(F.array_except("y.words", "x.words")).alias("only_b"), F.round(jaccard, 6).alias("jaccard"),
    )


def consensus(pairs: DataFrame) -> DataFrame:
    """Mean Jaccard over all pairs."""
    return pairs.agg(F.round(F.coalesce(F.avg("jaccard"), F.lit(0.0)), 6).alias("consensus"), F.count("*").alias("pairs"))


def accumulated(sets: DataFrame) -> Column:
    """All keywords of all groups, once each, sorted: an aggregate expression."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list("words"))))


def word_score(text: Column | str, keywords: tuple[str, ...]) -> Column:
    """Keyword agent of the documentation: whole-word counts, each damped by ln(1 + n), summed."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    words = F.split(t, "[^a-z0-9_]+")
    out = F.lit(0.0)
    for k in keywords:
        out = out + F.log1p((F.size(words) - F.size(F.array_remove(words, k))).cast("double"))
    return out
