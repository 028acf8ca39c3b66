"""The current graph: nodes and claims as of the newest commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.model import relation, state
from lodestone.operators.orphans import clean_key
from lodestone.session import read

EDGE_COLUMNS = ("src", "dst", "kind", "claim_class", "source_kind", "confidence_bp", "status", "fingerprint", "producer", "stale_reason", "valid_from")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that are not retired, one row per key: the youngest version.

    The choice is a map-side combined aggregate, so repeated rows of one key meet as one row.
    """
    key = clean_key(F.col("stable_key"))
    live = nodes.filter(F.col("retired_commit").isNull()).withColumn("stable_key", key).filter(F.col("stable_key").isNotNull())
    kept = [c for c in nodes.columns if c not in ("stable_key", "anchors")]
    newest = F.max(F.struct("created_commit", "recorded_at", "content_hash", *[c for c in kept if c not in ("created_commit", "recorded_at", "content_hash")])).alias("n")
    return live.groupBy("stable_key").agg(newest).select("stable_key", "n.*").withColumn("is_test", F.coalesce(F.col("symbol_kind") == "test", F.lit(False)))


def current_edges(edges: DataFrame) -> DataFrame:
    """Open claims with both ends, one row per edge id, in canonical spelling."""
    cleaned = edges.filter(F.col("valid_to").isNull()).select(
        "edge_id", *[clean_key(F.col(c)).alias(c) for c in ("src", "dst")], relation(F.col("kind")).alias("kind"),
        *[c for c in EDGE_COLUMNS if c not in ("src", "dst", "kind", "status")], state(F.col("status")).alias("status"),
    )
    return cleaned.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct().select(*EDGE_COLUMNS)


def latest_claims(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The semantic claims that the newest complete snapshot shows, after corrections."""
    newest = snapshots.filter("is_complete").agg(F.max("commit_seq").alias("commit_seq"))
    shown = rows.join(F.broadcast(newest), "commit_seq", "left_semi")  # one row
    kept = ["src", "dst", "kind", "claim_class", "source_kind", "confidence_bp", "status", "producer", "stale_reason", "commit_seq"]
    last = shown.groupBy("fingerprint").agg(F.max(F.struct("recorded_at", *kept)).alias("c"))
    return last.select(
        F.col("c.src").alias("src"), F.col("c.dst").alias("dst"), relation(F.col("c.kind")).alias("kind"), "c.claim_class", "c.source_kind",
        "c.confidence_bp", F.coalesce(state(F.col("c.status")), F.lit("active")).alias("status"), "fingerprint", "c.producer", "c.stale_reason",
        F.col("c.commit_seq").alias("valid_from"),
    )


def load(spark: SparkSession, sf_dir: str) -> Graph:
    claims = latest_claims(read(spark, sf_dir, "edge_snapshots"), read(spark, sf_dir, "index_snapshots"))
    edges = current_edges(read(spark, sf_dir, "edges")).unionByName(claims)
    return Graph(current_nodes(read(spark, sf_dir, "nodes")), edges)


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Keys with several open versions, with the commit that closes each but the last."""
    order = Window.partitionBy("stable_key").orderBy("created_commit", "content_hash")
    return nodes.withColumn("closes_at", F.lead("created_commit").over(order))
