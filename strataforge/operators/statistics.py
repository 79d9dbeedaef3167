"""Statistics over (group, item, value) tables: normalisation, variance, rank, correlation, prediction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def basic(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """count, mean, median, population deviation, min and max; zeros where there is no value."""
    v = F.col(value)
    parts = {"mean": F.avg(v), "median": F.median(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    return df.groupBy(*by).agg(F.count(v).alias("count"), *(_r(F.coalesce(x.cast("double"), F.lit(0.0))).alias(k) for k, x in parts.items()))


def shares(df: DataFrame, value: str, by: list[str], total: str) -> DataFrame:
    """Value as a share of its group's sum, 0 where the sum is 0."""
    whole = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(total, F.coalesce(F.try_divide(F.col(value), whole), F.lit(0.0)))


def spread(df: DataFrame, group: str, item: str, weight: str, high: float = 0.1, medium: float = 0.05) -> DataFrame:
    """Per item over the groups: mean, variance, deviation, variation, range, level, and the groups at both ends."""
    w = F.col(weight)
    out = df.groupBy(item).agg(F.avg(w).alias("mean"), F.var_pop(w).alias("variance"), F.stddev_pop(w).alias("std"), (F.max(w) - F.min(w)).alias("range"), F.max_by(group, F.struct(w, group)).alias("highest"), F.min_by(group, F.struct(w, group)).alias("lowest"))
    level = F.when(F.col("std") > high, "high").when(F.col("std") > medium, "medium").otherwise("low")
    cv = F.coalesce(F.try_divide(F.col("std"), F.col("mean")), F.lit(0.0))
    return out.select(item, *(_r(F.col(c)).alias(c) for c in ("mean", "variance", "std", "range")), _r(cv).alias("cv"), level.alias("level"), "highest", "lowest")


def around_mean(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Per item: the groups above and below its mean, as sorted lists joined by a comma."""
    mean = F.avg(weight).over(Window.partitionBy(item))
    marked = df.withColumn("__mean", mean)

    def side(test: Column) -> Column:
        return F.concat_ws(",", F.sort_array(F.collect_list(F.when(test, F.col(group)))))

    return marked.groupBy(item).agg(_r(F.first("__mean")).alias("mean"), side(F.col(weight) > F.col("__mean")).alias("above"), side(F.col(weight) < F.col("__mean")).alias("below"))


def leave_one_out(df: DataFrame, item: str, weight: str) -> DataFrame:
    """Adds the mean weight of the other groups of the item (null if there is none)."""
    w = Window.partitionBy(item)
    return df.withColumn("others", F.try_divide(F.sum(weight).over(w) - F.col(weight), F.count(weight).over(w) - 1))


def unique_traits(df: DataFrame, group: str, item: str, weight: str, more: float = 1.2, less: float = 0.8) -> DataFrame:
    """Items whose weight in a group is far from the mean of the other groups."""
    far = leave_one_out(df, item, weight)
    kind = F.when(F.col(weight) > more * F.col("others"), "emphasised").when(F.col(weight) < less * F.col("others"), "reduced")
    return far.withColumn("kind", kind).filter("kind is not null").select(group, item, "kind", _r(F.col(weight)).alias("weight"), _r(F.col("others")).alias("others"))


def ranked(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Rank of items in their group by weight, ties by item."""
    w = Window.partitionBy(group).orderBy(F.desc(weight), item)
    return df.select(group, item, _r(F.col(weight)).alias("weight"), F.row_number().over(w).alias("rank"))


def leaders(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Per item the group that weighs it most, and all groups in order of weight."""
    order = F.sort_array(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(group).alias("g"))))
    return df.groupBy(item).agg(order.alias("o")).select(item, F.col("o")[0]["g"].alias("leader"), F.concat_ws(">", F.transform("o", lambda x: x["g"])).alias("ordered"))


def priorities(df: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """high over mean + std of the group, low under mean - std, else medium."""
    w = Window.partitionBy(group)
    mean, std = F.avg(weight).over(w), F.stddev_pop(weight).over(w)
    level = F.when(F.col(weight) > _r(mean + std, 9), "high").when(F.col(weight) < _r(mean - std, 9), "low").otherwise("medium")
    return df.select(group, item, level.alias("priority"), _r(mean).alias("mean"), _r(std).alias("std"))


def emphasised(df: DataFrame, item: str, weight: str, emphasis: DataFrame, by: list[str] = ()) -> DataFrame:
    """Weights replaced where ``emphasis`` (item, emphasis) has the item, then scaled to sum to 1 in each group."""
    joined = df.join(emphasis, item, "left").withColumn("w", F.coalesce("emphasis", weight))
    return joined.withColumn("adjusted", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy(*by)))).drop("w", "emphasis")


def correlations(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Pearson correlation of each feature with the target over rows that have both; 0 where either is constant."""
    rows = []
    for f in features:
        both = F.col(f).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(f).cast("double")), F.when(both, F.col(target).cast("double"))
        rows.append((f, x, y))
    parts = []
    for f, x, y in rows:
        n, mx, my = F.count(x), F.avg(x), F.avg(y)
        cov, sx, sy = F.avg(x * y) - mx * my, F.stddev_pop(x), F.stddev_pop(y)
        parts.append(F.struct(F.lit(f).alias("feature"), F.when((n > 1) & (sx > 0) & (sy > 0), F.try_divide(cov, sx * sy)).otherwise(0.0).alias("r")))
    out = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.feature", _r(F.col("p.r")).alias("r"))
    strength = F.when(F.abs("r") > 0.7, "strong").when(F.abs("r") > 0.4, "moderate").otherwise("weak")
    return out.withColumn("strength", strength).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "feature")))


def correlation_weights(found: DataFrame) -> DataFrame:
    """Absolute correlations scaled to sum to 1."""
    whole = F.sum(F.abs("r")).over(Window.partitionBy())
    return found.select("feature", _r(F.coalesce(F.try_divide(F.abs("r"), whole), F.lit(0.0))).alias("weight"))


def predictive_power(df: DataFrame, success: str, features: list[str], least: float = 0.2) -> DataFrame:
    """Share of successes that have a boolean feature less the share of failures that have it."""

    def rate(f: str, kind: bool) -> Column:
        return F.coalesce(F.avg(F.when(F.col(success) == kind, F.col(f).cast("double"))), F.lit(0.0))

    parts = [F.struct(F.lit(f).alias("feature"), rate(f, True).alias("yes"), rate(f, False).alias("no")) for f in features]
    out = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.feature", "p.yes", "p.no")
    power = F.col("yes") - F.col("no")
    return out.select("feature", _r(F.col("yes")).alias("success_rate"), _r(F.col("no")).alias("failure_rate"), _r(power).alias("power"), (power > least).alias("predictive"))


def prevalence(df: DataFrame, features: list[str], indicator: float = 0.7) -> DataFrame:
    """How many rows have each boolean feature, and whether that makes it an indicator."""
    parts = [F.struct(F.lit(f).alias("feature"), F.count_if(F.col(f)).alias("n"), F.avg(F.col(f).cast("double")).alias("share")) for f in features]
    out = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.feature", "p.n", _r(F.coalesce("p.share", F.lit(0.0))).alias("share"))
    return out.withColumn("indicator", F.col("share") > indicator)


def binned(df: DataFrame, value: str, bounds: list[tuple[float, str]], rest: str) -> DataFrame:
    """Rows by class of value: the first bound it is under names it."""
    kind = reduce(lambda w, b: w.when(F.col(value) < b[0], b[1]), bounds[1:], F.when(F.col(value) < bounds[0][0], bounds[0][1])).otherwise(rest)
    return df.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), _r(F.avg(value)).alias("mean"))


def quartiles(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(_r(F.percentile(F.col(value), F.lit(p))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))), _r(F.avg(value)).alias("mean"))


def confidence(df: DataFrame, by: str, weight: str) -> DataFrame:
    """Cross-validation score: 1 less the variation of the weights, not under 0; 0 where the mean is 0."""
    mean, std = F.avg(weight), F.stddev_pop(weight)
    return df.groupBy(by).agg(_r(F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(std, mean)), F.lit(0.0))).alias("score"))
