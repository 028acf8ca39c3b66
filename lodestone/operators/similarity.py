"""Texts that share most of their terms, and their clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import components
from lodestone.session import materialise

NUM, DEN = 3, 5  # share of the smaller set's terms that must be common


def overlap_pairs(docs: DataFrame, key: str, group: str, terms: str) -> DataFrame:
    """(a, b) of classes of equal term sets within a group that share 3/5 of the smaller set.

    Equal sets meet first and stand as one class, named by the least key; a class is compared by
    its representative, so copies are never expanded into pairs. A pair has to share one of the
    rarest n - ceil(3n/5) + 1 terms of its smaller set: only those are indexed, and the common
    ones stay out. Every candidate is verified on the whole sets.
    """
    sets = docs.select(key, group, F.array_sort(F.array_distinct(terms)).alias("t")).filter(F.size("t") > 0)
    classes = materialise(sets.groupBy(group, "t").agg(F.min(key).alias("rep")).withColumn("n", F.size("t")), "classes")
    flat = classes.select(group, "rep", "n", F.explode("t").alias("term"))
    counts = flat.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(counts, [group, "term"]).groupBy(group, "rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("o"))
    need = F.ceil(F.col("n") * NUM / DEN).cast("int")
    prefix = ordered.select(group, F.col("rep").alias("small"), F.col("n").alias("ns"), F.explode(F.slice(F.transform("o", lambda x: x["term"]), F.lit(1), F.col("n") - need + 1)).alias("term"))
    probe = flat.select(group, F.col("rep").alias("large"), F.col("n").alias("nl"), "term")
    smaller = (F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("small") < F.col("large")))
    found = prefix.join(probe, [group, "term"]).filter(smaller).select(group, "small", "large").distinct()
    left = classes.select(F.col("rep").alias("small"), F.col("t").alias("ts"), group)
    right = classes.select(F.col("rep").alias("large"), F.col("t").alias("tl"), group)
    shared = F.size(F.array_intersect("ts", "tl"))
    checked = found.join(left, [group, "small"]).join(right, [group, "large"]).filter(shared * DEN >= F.size("ts") * NUM)
    return checked.select(group, F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"))


def classes_of(docs: DataFrame, key: str, group: str, terms: str) -> DataFrame:
    """(key, rep) of each document with a term set: the class whose set equals its own."""
    sets = docs.select(key, group, F.array_sort(F.array_distinct(terms)).alias("t")).filter(F.size("t") > 0)
    reps = sets.groupBy(group, "t").agg(F.min(key).alias("rep"))
    return sets.join(reps, [group, "t"]).select(key, "rep")


def clusters(docs: DataFrame, key: str, group: str, terms: str) -> DataFrame:
    """(key, cluster) of every document with terms: components over overlapping classes."""
    joined = components(overlap_pairs(docs, key, group, terms))
    own = classes_of(docs, key, group, terms)
    return own.join(joined.withColumnRenamed("key", "rep"), "rep", "left").select(key, F.coalesce("root", "rep").alias("cluster"))
