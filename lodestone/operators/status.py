"""Health of an index and of its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(freshness: DataFrame, stale: DataFrame, unmapped: DataFrame, intents: DataFrame) -> DataFrame:
    """(repo, health, notice) of each repository; the counts are one row each.

    An index that is not current comes first, then stale claims, no documents, unmapped ones.
    """
    counts = stale.agg(F.count(F.lit(1)).alias("stale")).join(unmapped.agg(F.count(F.lit(1)).alias("unmapped"))).join(intents.agg(F.count(F.lit(1)).alias("intents")))
    j = freshness.join(F.broadcast(counts))  # one row
    level = (
        F.when(F.col("freshness") != "current", "needs_index").when(F.col("stale") > 0, "needs_attention").when(F.col("intents") == 0, "needs_context")
        .when(F.col("unmapped") > 0, "needs_mappings").otherwise("ready")
    )
    say = lambda n, text: F.concat(F.col(n).cast("string"), F.lit(text))
    notice = (
        F.when(F.col("freshness") == "not_indexed", "No commit has been indexed.").when(F.col("freshness") == "behind", "The graph is behind the newest commit.")
        .when(F.col("stale") > 0, say("stale", " semantic relationships are stale.")).when(F.col("intents") == 0, "No documents are indexed.")
        .when(F.col("unmapped") > 0, say("unmapped", " documents have no active mapping.")).otherwise("")
    )
    return j.select("repo", level.alias("health"), notice.alias("notice"))


def neighbor_states(endpoints: DataFrame, since: str) -> DataFrame:
    """(neighbor, endpoints, offered, newest, state) of each repository that offers endpoints."""
    rows = endpoints.select("source_repo", "method", "path", "published_at", "withdrawn_at").distinct()
    g = rows.groupBy(F.col("source_repo").alias("neighbor")).agg(
        F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("withdrawn_at").isNull()).alias("offered"), F.max("published_at").alias("newest")
    )
    state = F.when(F.col("offered") == 0, "empty").when(F.col("newest") >= F.lit(since).cast("timestamp_ntz"), "changed").otherwise("current")
    return g.withColumn("state", state)
