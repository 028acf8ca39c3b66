"""Greedy packing into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 4000


def pack(items: DataFrame, group: str, size: str, order: list, item: str, budget: int = BUDGET) -> DataFrame:
    """(group, item, size) that fit: in order, each item that still fits is taken, others are skipped.

    Of one size s at most budget / s items can ever be taken, and those are the first ones. So per
    group and size only that many take part, at most budget x (1 + ln budget) items, before they
    meet in one ordered fold: exact, and bounded whatever the size of the group. Items without
    size, or of size 0, take no room and are left out.
    """
    real = items.filter((F.col(size) > 0) & (F.col(size) <= budget))
    by_size = Window.partitionBy(group, size).orderBy(*order)
    few = real.withColumn("_n", F.row_number().over(by_size)).filter((F.col("_n") <= budget) & (F.col("_n") * F.col(size) <= budget))  # the first test is one Spark applies before the shuffle
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rank", F.col(size).cast("long").alias("size"), F.col(item).alias("item")))).alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("room"), F.filter("all", lambda x: F.lit(False)).alias("taken"))
    folded = F.aggregate(
        "all", start,
        lambda acc, x: F.when(x["size"] <= acc["room"], F.struct((acc["room"] - x["size"]).alias("room"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc),
    )
    return lists.select(group, F.inline(folded["taken"])).select(group, F.col("item").alias(item), F.col("size").alias(size))
