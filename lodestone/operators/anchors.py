"""Anchors that documents put on decision points: a symbol, a fingerprint and which occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors_of(nodes: DataFrame) -> DataFrame:
    """(document, symbol, fingerprint, ordinal) of all documents, each once."""
    return nodes.filter("anchors is not null").select(F.col("stable_key").alias("document"), F.inline("anchors")).select("document", "symbol", "fingerprint", "ordinal").distinct()


def documents_of(nodes: DataFrame) -> DataFrame:
    """(symbol, fingerprint, ordinal, documents): the documents of each anchor, by name."""
    return anchors_of(nodes).groupBy("symbol", "fingerprint", "ordinal").agg(F.array_join(F.array_sort(F.collect_set("document")), ",").alias("documents"))


def confirmed(intents: DataFrame, points: DataFrame) -> DataFrame:
    """Anchors of the intents that some occurrence of their point bears out: the nth exists, n >= 1."""
    counts = points.groupBy("symbol", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    named = anchors_of(intents).select("symbol", "fingerprint", "ordinal").distinct().filter("ordinal >= 1")
    return named.join(counts, ["symbol", "fingerprint"]).filter(F.col("ordinal") <= F.col("n")).drop("n")


def new_points(before: DataFrame, now: DataFrame, known: DataFrame) -> DataFrame:
    """(symbol, fingerprint, ordinal, line) of points beyond as many as stood before, and not anchored.

    Both sides: (symbol, fingerprint, line). Occurrences of one fingerprint in a symbol are told
    apart by their order.
    """
    was = before.groupBy("symbol", "fingerprint").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("symbol", "fingerprint").orderBy("line")
    placed = now.withColumn("ordinal", F.row_number().over(order)).join(was, ["symbol", "fingerprint"], "left")
    fresh = placed.filter(F.col("ordinal") > F.coalesce("n", F.lit(0)))
    return fresh.join(known.select("symbol", "fingerprint", "ordinal"), ["symbol", "fingerprint", "ordinal"], "left_anti").select("symbol", "fingerprint", "ordinal", "line")
