"""Evaluation: agreement of raters, precision of rankings, reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rater_pairs(labels: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """(a, b) labels of two raters of one item: the first and last rater by name.

    One row per item with at least two raters; more than two give the outermost pair.
    """
    ends = labels.groupBy(item).agg(F.min(F.struct(rater, label)).alias("lo"), F.max(F.struct(rater, label)).alias("hi"))
    return ends.filter(F.col(f"lo.{rater}") != F.col(f"hi.{rater}")).select(item, F.col(f"lo.{label}").alias("a"), F.col(f"hi.{label}").alias("b"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame) -> DataFrame:
    """(n, observed, expected, kappa): Cohen's kappa; null without pairs or where chance explains all."""
    cells = confusion(pairs)
    rows = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "label").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    n = F.col("n").cast("double")
    one = total.join(chance).select("n", F.try_divide(F.col("same"), n).alias("observed"), F.try_divide(F.coalesce("rc", F.lit(0)), n * n).alias("expected"))  # one row each
    return one.select("n", "observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def precision_at(ranked: DataFrame, group: str, score: str, item: str, hit: Column, k: int) -> DataFrame:
    """(group, shown, hits, precision) of the k best of each group; unrated items count as misses."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    top = ranked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    hits = F.count_if(F.coalesce(hit, F.lit(False)))
    return top.groupBy(group).agg(F.count(F.lit(1)).alias("shown"), hits.alias("hits"), F.try_divide(hits, F.count(F.lit(1))).alias("precision"))


def round_robin(rows: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """Rank within the group and the group's place in each round: an interleaving order."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(item))
    return rows.withColumn("turn", F.row_number().over(order)).select(group, item, "turn")


def hash_sample(rows: DataFrame, group: str, item: str, seed: str, k: int) -> DataFrame:
    """The k items of each group with the least hash of seed and item: a sample anyone can repeat."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(group, item, "place")
