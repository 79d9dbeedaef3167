"""Vector operators: cosine, pairs over a threshold, top-k, clusters, hybrid retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(df: DataFrame, vector: str) -> DataFrame:
    """The vector scaled to length 1, so that cosine is a dot product."""
    length = norm(F.col(vector))
    return df.withColumn(vector, F.transform(vector, lambda x: F.try_divide(x.cast("double"), length)))


#: Vectors of a block that meets another in one matrix product; blocks beyond MOST_BLOCKS come only where one would pass LARGEST.
BLOCK, MOST_BLOCKS, LARGEST = 512, 16, 1 << 16
#: Rows of a block that are multiplied at a time.
SLICE = 256


def blocks_of(n: int) -> int:
    return max(1, min(-(-n // BLOCK), MOST_BLOCKS), -(-n // LARGEST))


def keyword_links(keywords: DataFrame, key: str, dimension: str, vector: str, least: float) -> DataFrame:
    """(a, b, dim_a, dim_b, similarity): pairs of keywords of different dimensions that are similar, a the smaller key.

    Keywords are compared as a stated set: dealt into blocks, and every two blocks meet in one task as
    matrix products, so no pair is a row unless it is similar.  Each vector is sent to every block: to
    MOST_BLOCKS at most as long as MOST_BLOCKS * LARGEST vectors do, so what is shuffled grows with the vectors and not with
    their pairs.  Null keys, dimensions and vectors and vectors without a direction link with nothing.
    """
    fine = F.col(key).isNotNull() & F.col(dimension).isNotNull() & F.forall(vector, lambda x: x.isNotNull()) & (norm(F.col(vector)) > 0)
    rows = keywords.filter(F.coalesce(fine, F.lit(False)))
    blocks = blocks_of(keywords.count())
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = rows.select(own.alias("own"), F.col(key).alias("key"), F.col(dimension).alias("dim"), F.col(vector).alias("v"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "dim", "v")
    kinds = keywords.schema[key].dataType.simpleString(), keywords.schema[dimension].dataType.simpleString()

    def linked(block: pa.Table) -> pa.Table:
        i, j, own = (block[c].to_numpy() for c in ("i", "j", "own"))
        one, two = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        keys, dims = (block[c].to_numpy() for c in ("key", "dim"))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(one) and len(two):
            v = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(block), -1)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            right = np.ascontiguousarray(v[two].T)
            for at in range(0, len(one), SLICE):
                some = one[at : at + SLICE]
                score = v[some] @ right
                x, y = np.nonzero(score > least)
                left, other, score = some[x], two[y], score[x, y]
                keep = dims[left] != dims[other]
                # within a block both orders of a pair come up, between blocks one
                keep &= keys[left] < keys[other] if i[0] == j[0] else keys[left] != keys[other]
                out.append((left[keep], other[keep], score[keep]))
        left, other, score = (np.concatenate(c) for c in zip(*out, strict=True))
        swap = keys[left] > keys[other]
        a, b = pa.array(np.where(swap, other, left)), pa.array(np.where(swap, left, other))
        return pa.table({"a": block["key"].take(a), "b": block["key"].take(b), "dim_a": block["dim"].take(a), "dim_b": block["dim"].take(b), "similarity": score})

    # a task for each two blocks: what a task computes is far more than what it reads
    dealt = rows.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j")
    return dealt.applyInArrow(linked, f"a {kinds[0]}, b {kinds[0]}, dim_a {kinds[1]}, dim_b {kinds[1]}, similarity double")


def conflicts(links: DataFrame, pairs: list[tuple], least: float) -> DataFrame:
    """Links above ``least`` whose two dimensions are one of the conflicting pairs, in either order."""
    wanted = [F.array(*map(F.lit, sorted(p))) for p in pairs]
    both = F.array_sort(F.array("dim_a", "dim_b"))
    return links.filter((F.col("similarity") > least) & both.isin(*wanted))


#: Rows and queries of two blocks that meet in one task.
TOP_BLOCK = 4096


def top_k(rows: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, key, score): the nearest rows of each query by cosine but the query itself, exactly.

    Queries are a stated set.  Rows and queries are dealt into blocks; every two blocks meet in one task as a matrix
    product that keeps ``k`` rows a query, so no pair beyond those is a row.  Vectors
    without a direction are left out.
    """
    u = unit(rows.select(key, vector), vector).filter(F.forall(vector, lambda x: x.isNotNull()))
    q = unit(queries.select(F.col(key).alias("query"), F.col(vector).alias("q")), "q").filter(F.forall("q", lambda x: x.isNotNull()))
    n, m = (max(1, -(-t.count() // TOP_BLOCK)) for t in (rows, queries))
    left = q.select("query", "q", F.pmod(F.xxhash64("query"), F.lit(m)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    right = u.select(key, F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    kinds = queries.schema[key].dataType.simpleString(), rows.schema[key].dataType.simpleString()

    def best(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or block.empty:
            return pd.DataFrame({"query": asked["query"][:0], key: block[key][:0], "score": []})
        block = block.sort_values(key, kind="stable")
        keys, x, y = block[key].to_numpy(), np.stack(asked["q"].to_numpy()), np.stack(block["v"].to_numpy())
        out = []
        for i in range(0, len(x), 256):
            score = x[i : i + 256] @ y.T
            for query, row in zip(asked["query"].to_numpy()[i : i + 256], np.where(keys[None, :] == asked["query"].to_numpy()[i : i + 256, None], -np.inf, score), strict=True):
                order = np.argsort(-np.round(row, 9), kind="stable")[:k]
                order = order[np.isfinite(row[order])]
                out.append(pd.DataFrame({"query": query, key: keys[order], "score": row[order]}))
        return pd.concat(out, ignore_index=True)

    scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, f"query {kinds[0]}, {key} {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", key, "score", "rank")


def clusters(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, cluster): connected components of links, by least label; density clustering with two points a core.

    Labels spread along links and jump over their own labels until none changes.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = edges.union(edges.select("y", "x")).distinct().persist()
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("cluster"))
    while True:
        near = edges.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("cluster").alias("c"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("cluster").alias("was"), F.least("cluster", "c").alias("cluster"))
        up = labels.select(F.col("node").alias("up"), F.col("cluster").alias("above"))
        step = step.join(up, F.col("cluster") == F.col("up")).select("node", "was", F.least("cluster", "above").alias("cluster"))
        new = kept(step, "labels")
        labels = new.select("node", "cluster")
        if new.filter("cluster <> was").isEmpty():
            break
    edges.unpersist()
    return labels


def degrees(links: DataFrame, a: str, b: str) -> DataFrame:
    both = links.select(F.explode(F.array(a, b)).alias("node"))  # links are computed once, and counted before they are shuffled
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def merged(vector_hits: DataFrame, graph_hits: DataFrame, vector_weight: float, graph_weight: float, k: int) -> DataFrame:
    """(key, score): weighted sum of two result lists of (key, score), the best ``k``."""
    both = vector_hits.select("key", (F.col("score") * vector_weight).alias("score")).union(graph_hits.select("key", (F.col("score") * graph_weight).alias("score")))
    return both.groupBy("key").agg(F.sum("score").alias("score")).orderBy(F.desc(F.round("score", 9)), "key").limit(k)


def feature_similarity(df: DataFrame, pairs: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Share of equal values over the features both have, for each pair (a, b)."""
    x, y = df.alias("x"), df.alias("y")
    joined = pairs.join(x, F.col("a") == F.col(f"x.{key}")).join(y, F.col("b") == F.col(f"y.{key}"))
    common = sum((F.col(f"x.{f}").isNotNull() & F.col(f"y.{f}").isNotNull()).cast("int") for f in features)
    same = sum(F.coalesce((F.col(f"x.{f}") == F.col(f"y.{f}")).cast("int"), F.lit(0)) for f in features)
    return joined.select("a", "b", F.round(F.coalesce(F.try_divide(same, common), F.lit(0.0)), 6).alias("similarity"))
