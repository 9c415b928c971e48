"""Aggregates that take any DataFrames: rates, ratios, networks, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Rows of each combination."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def gini(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Gini index of a count over the rows of each group, in closed form over ranks; 0 for one row or none counted."""
    w = Window.partitionBy(*keys).orderBy(count)
    ranked = df.withColumn("_i", F.row_number().over(w))
    n, total = F.count(F.lit(1)), F.sum(count)
    raw = (2 * F.sum(F.col("_i") * F.col(count)) - (n + 1) * total) / (n * total)
    return ranked.groupBy(*keys).agg(F.when((n <= 1) | (total == 0), F.lit(0.0)).otherwise(raw).alias("gini"))


def fill_rates(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows of each group and how many meet each rule, in one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()))


def bucketed(df: DataFrame, value: str, bounds: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Histogram over ``value < bound`` steps, with the last name beyond and ``unknown`` for null."""
    step = F.when(F.col(value).isNull(), "unknown")
    for bound, name in zip(bounds, names, strict=False):
        step = step.when(F.col(value) < bound, name)
    return frequency(df.select(step.otherwise(names[-1]).alias("bucket")), "bucket")


def adjusted_rand(df: DataFrame, cluster: str, category: str, noise: int | None = None) -> DataFrame:
    """Adjusted Rand index of two labellings of the rows, from their contingency table, and its band; 0 for ten rows or fewer.

    Rows whose cluster is ``noise`` don't count. Bands: strong above 0.5, moderate above 0.3, else weak.
    """
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    kept = df if noise is None else df.filter(F.col(cluster) != noise)
    cells = kept.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("n"))
    inside = cells.agg(F.sum(pairs("n")).alias("i"), F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    a = cells.groupBy(cluster).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("a"))
    b = cells.groupBy(category).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("b"))
    one = inside.join(a, F.lit(True)).join(b, F.lit(True))
    expected = F.col("a") * F.col("b") / pairs("t")
    index = F.when((F.col("t") <= 10) | ((F.col("a") + F.col("b")) / 2 == expected), F.lit(0.0)).otherwise(F.round((F.col("i") - expected) / ((F.col("a") + F.col("b")) / 2 - expected), 6))
    return one.select(index.alias("ari")).withColumn("band", F.when(F.col("ari") > 0.5, "strong").when(F.col("ari") > 0.3, "moderate").otherwise("weak"))


def composition(df: DataFrame, cluster: str, category: str, most: int = 3, noise: int | None = None) -> DataFrame:
    """The ``most`` most frequent categories of each cluster with their counts, ties to the lower category; noise is no cluster."""
    counts = frequency(df if noise is None else df.filter(F.col(cluster) != noise), cluster, category)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), F.asc(category)))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def edge_degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Weighted distinct edges and their targets' in-degree."""
    weighted = frequency(edges, source, target, name="weight")
    return weighted.join(frequency(weighted, target, name="in_degree"), target)
