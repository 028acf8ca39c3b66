"""Queries on evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluate
from lodestone.session import read
from lodestone.sources.graph import load


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rater_pairs(read(spark, d, "reading_labels"), "doc_id", "rater", "reading_level")


def rater_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_pairs(spark, d))


def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.kappa(_pairs(spark, d))


def precision_at_five(spark: SparkSession, d: str) -> DataFrame:
    """Of the five most confident claims of each producer and kind, how many are still active."""
    edges = load(spark, d).edges.withColumn("ranking", F.concat_ws("/", "producer", "kind")).select("ranking", "fingerprint", "confidence_bp", "status").distinct()
    return evaluate.precision_at(edges, "ranking", "confidence_bp", "fingerprint", F.col("status") == "active", 5)


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("source", "doc_id", "n_chars")
    return evaluate.round_robin(docs, "source", "n_chars", "doc_id")


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.hash_sample(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "42:", 10)


def suite_sizes(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "eval_items")
    return items.groupBy("suite").agg(F.count(F.lit(1)).alias("items"), F.min("item_id").alias("first"), F.max("item_id").alias("last"))


QUERIES = {f.__name__: f for f in (rater_confusion, rater_kappa, precision_at_five, round_robin, hash_sample, suite_sizes)}

from lodestone.plans.graph_queries import GRAPH  # noqa: E402

_PAIRS = """p AS (SELECT doc_id, min((rater, reading_level)) AS lo, max((rater, reading_level)) AS hi FROM reading_labels GROUP BY doc_id HAVING min(rater) <> max(rater)),
 c AS (SELECT lo[2] AS a, hi[2] AS b, count(*) AS n FROM p GROUP BY 1, 2)"""

ORACLE = {
    "rater_confusion": f"WITH {_PAIRS} SELECT a, b, n FROM c",
    "rater_kappa": f"""WITH {_PAIRS}, t AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (a = b) AS same FROM c), r AS (SELECT a AS l, sum(n) AS r FROM c GROUP BY 1), q AS (SELECT b AS l, sum(n) AS q FROM c GROUP BY 1),
 x AS (SELECT sum(r * q) AS rc FROM r JOIN q USING (l)), o AS (SELECT n, coalesce(same, 0)::DOUBLE / n AS observed, coalesce(rc, 0)::DOUBLE / (n::DOUBLE * n) AS expected FROM t, x)
 SELECT n, observed, expected, CASE WHEN expected <> 1 THEN (observed - expected) / (1 - expected) END AS kappa FROM o""",
    "precision_at_five": f"""WITH {GRAPH}, r AS (SELECT DISTINCT concat_ws('/', producer, kind) AS ranking, fingerprint, confidence_bp, status FROM e),
 t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ranking ORDER BY confidence_bp DESC, fingerprint, status) <= 5)
 SELECT ranking, count(*) AS shown, count(*) FILTER (status = 'active') AS hits, count(*) FILTER (status = 'active')::DOUBLE / count(*) AS precision FROM t GROUP BY ranking""",
    "round_robin": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id)::INT AS turn FROM documents",
    "hash_sample": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id))::INT AS place FROM documents QUALIFY place <= 10",
    "suite_sizes": "SELECT suite, count(*) AS items, min(item_id) AS first, max(item_id) AS last FROM eval_items GROUP BY suite",
}
