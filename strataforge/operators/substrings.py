"""Joins of strings by containment through an index of short substrings (up to three characters): equi-joins only.

A needle is looked up by the one of its trigrams that stands in the fewest places; where that stands in a
longer string at a place that leaves room for the needle on both sides, the needle is compared.  Needles shorter
than three characters are their own key.  Nothing is compared that does not share the key, and no pair is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 3


def _grams(text: Column, n: int) -> Column:
    """(gram, at) of all runs of n characters, places from 1; the empty run once."""
    if n == 0:
        return F.array(F.struct(F.lit("").alias("gram"), F.lit(1).alias("at")))
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substr(text, i, F.lit(n)).alias("gram"), i.cast("int").alias("at")))


def contained(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """(needle, hay): each distinct needle with each distinct string that holds it; nulls hold and are held by nothing.

    A needle equal to the string counts; the empty needle is in every string.
    """
    short = needles.select(F.col(needle).alias("needle")).filter("needle is not null").distinct()
    long = hay.select(F.col(text).alias("hay")).filter("hay is not null").distinct()
    own = F.when(F.length("needle") >= LONGEST, _grams(F.col("needle"), LONGEST)).otherwise(F.array(F.struct(F.col("needle").alias("gram"), F.lit(1).alias("at"))))
    asked = short.select("needle", F.explode(own).alias("g")).select("needle", "g.gram", "g.at")
    wanted = asked.select("gram").distinct()
    places = long.select("hay", F.explode(F.concat(*(_grams(F.col("hay"), n) for n in range(LONGEST + 1)))).alias("g")).select("hay", F.col("g.gram").alias("gram"), F.col("g.at").alias("stands"))
    places = places.join(wanted, "gram", "left_semi")
    often = places.groupBy("gram").agg(F.count("*").alias("places"))
    # a gram that stands nowhere rules its needle out: it is the rarest, with no place
    key = asked.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("places", F.lit(0)), "gram", "at")).alias("k")).select("needle", "k.gram", "k.at")
    begin = F.col("stands") - F.col("at") + 1
    room = (begin >= 1) & (begin + F.length("needle") - 1 <= F.length("hay"))
    found = key.join(places, "gram").filter(room & (F.substr("hay", begin, F.length("needle")) == F.col("needle")))
    return found.select("needle", "hay").distinct()


def either_way(one: DataFrame, a: str, two: DataFrame, b: str) -> DataFrame:
    """(a, b): distinct strings of which one holds the other."""
    left, right = one.select(F.col(a).alias("a")), two.select(F.col(b).alias("b"))
    forth = contained(left, "a", right, "b").select(F.col("needle").alias("a"), F.col("hay").alias("b"))
    back = contained(right, "b", left, "a").select(F.col("hay").alias("a"), F.col("needle").alias("b"))
    return forth.union(back).distinct()


def expanded(seeds: DataFrame, seed: str, vocabulary: DataFrame, term: str, order: str, most: int = 5) -> DataFrame:
    """(seed, term, place): the first ``most`` terms in vocabulary order of which one holds the other, in lower case."""
    s = seeds.select(F.col(seed).alias("seed"), F.lower(seed).alias("a")).distinct()
    v = vocabulary.groupBy(F.col(term).alias("term")).agg(F.min(order).alias("order")).withColumn("b", F.lower("term"))
    both = either_way(s, "a", v, "b").join(s, "a").join(v, "b")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("order", "term"))
    return both.withColumn("place", place).filter(F.col("place") <= most).select("seed", "term", "place")
