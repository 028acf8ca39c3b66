"""Queries on merges and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import coverage, history, store
from lodestone.plans.change_queries import _shown
from lodestone.session import read
from lodestone.sources.graph import load


def scd2_merge(spark: SparkSession, d: str) -> DataFrame:
    """The claims of the third last complete snapshot, with the two after it merged in."""
    whole = history.complete(read(spark, d, "index_snapshots"), 3)[::-1]
    side = lambda n: _shown(spark, d, n).select("fingerprint", "status", "producer")
    start = side(3).withColumn("valid_from", F.lit(whole[-3]).cast("long")).withColumn("valid_to", F.lit(None).cast("long"))
    merged = store.scd2_merge(start, side(2), ["fingerprint"], ["status", "producer"], whole[-2])
    return store.scd2_merge(merged, side(1), ["fingerprint"], ["status", "producer"], whole[-1])


def upsert_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues fetched in the second half of the project over those of the first half."""
    rows = read(spark, d, "jira_issues").select("issue_key", "issue_id", "project_key", "summary", "fetched_at").distinct()
    late = F.col("fetched_at") >= F.lit("2025-01-01").cast("timestamp_ntz")
    return store.upsert(rows.filter(~late), rows.filter(late), ["issue_key"], ["fetched_at", "issue_id"]).select("issue_key", "issue_id", "summary")


def unreferenced_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Current nodes that no open claim touches, by kind."""
    graph = load(spark, d)
    ends = graph.edges.select(F.col("src").alias("k")).union(graph.edges.select("dst"))
    return store.unreferenced(graph.nodes, "stable_key", ends, "k").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def downstream_weight(spark: SparkSession, d: str) -> DataFrame:
    return coverage.downstream(load(spark, d))


def symbol_effects(spark: SparkSession, d: str) -> DataFrame:
    return coverage.effects(load(spark, d))


def call_hubs(spark: SparkSession, d: str) -> DataFrame:
    return coverage.hubs(load(spark, d))


QUERIES = {f.__name__: f for f in (scd2_merge, upsert_issues, unreferenced_nodes, downstream_weight, symbol_effects, call_hubs)}

from lodestone.plans.change_queries import _shown_sql  # noqa: E402
from lodestone.plans.graph_queries import _CALLS, GRAPH  # noqa: E402

_COMMIT = "(SELECT commit_seq FROM index_snapshots WHERE is_complete ORDER BY commit_seq DESC LIMIT 1 OFFSET {})"
_EFFECTS = """ef AS (SELECT src AS key, sum(CASE kind WHEN 'reads_from' THEN 2 ELSE 5 END)::BIGINT AS effects FROM (SELECT DISTINCT src, dst, kind FROM e WHERE status = 'active' AND kind IN ('writes_to','reads_from','calls_external')) GROUP BY src)"""
ORACLE = {
    "scd2_merge": f"""WITH {_shown_sql('s3', 3)}, {_shown_sql('s2', 2)}, {_shown_sql('s1', 1)},
 h AS (SELECT fingerprint, status, producer, {_COMMIT.format(2)} AS c FROM s3 UNION ALL SELECT fingerprint, status, producer, {_COMMIT.format(1)} FROM s2 UNION ALL SELECT fingerprint, status, producer, {_COMMIT.format(0)} FROM s1),
 g AS (SELECT *, CASE WHEN c = {_COMMIT.format(2)} THEN {_COMMIT.format(1)} WHEN c = {_COMMIT.format(1)} THEN {_COMMIT.format(0)} END AS nc, lag(c) OVER w AS pc, lag(status) OVER w AS ps, lag(producer) OVER w AS pp FROM h WINDOW w AS (PARTITION BY fingerprint ORDER BY c)),
 m AS (SELECT *, CASE WHEN pc IS NOT NULL AND ps IS NOT DISTINCT FROM status AND pp = producer AND (pc = {_COMMIT.format(2)} AND c = {_COMMIT.format(1)} OR pc = {_COMMIT.format(1)} AND c = {_COMMIT.format(0)}) THEN 0 ELSE 1 END AS f FROM g),
 r AS (SELECT *, sum(f) OVER (PARTITION BY fingerprint ORDER BY c) AS run FROM m)
 SELECT fingerprint, any_value(status) AS status, any_value(producer) AS producer, min(c) AS valid_from, arg_max(nc, c) AS x, CASE WHEN max(c) = {_COMMIT.format(0)} THEN NULL ELSE max(nc) END AS valid_to FROM r GROUP BY fingerprint, run""".replace("arg_max(nc, c) AS x, ", ""),
    "upsert_issues": """SELECT issue_key, issue_id, summary FROM (SELECT DISTINCT issue_key, issue_id, project_key, summary, fetched_at FROM jira_issues)
 QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY fetched_at >= TIMESTAMP '2025-01-01' DESC, fetched_at DESC, issue_id DESC) = 1""",
    "unreferenced_nodes": f"WITH {GRAPH} SELECT kind, count(*) AS n FROM n WHERE stable_key NOT IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY kind",
    "symbol_effects": f"WITH {GRAPH}, {_EFFECTS} SELECT key, effects FROM ef",
    "downstream_weight": f"""WITH {GRAPH}, {_CALLS}, {_EFFECTS}, r2 AS (SELECT DISTINCT x.a, y.b FROM calls x JOIN calls y ON x.b = y.a), r3 AS (SELECT DISTINCT x.a, y.b FROM r2 x JOIN calls y ON x.b = y.a),
 r AS (SELECT a, b, min(depth) AS depth FROM (SELECT a, b, 1 AS depth FROM calls UNION ALL SELECT a, b, 2 FROM r2 UNION ALL SELECT a, b, 3 FROM r3) GROUP BY a, b)
 SELECT a AS key, least(8, sum(1 + floor(coalesce(effects, 0) / depth)))::BIGINT AS weight FROM r LEFT JOIN ef ON ef.key = b WHERE a <> b GROUP BY a""",
    "call_hubs": f"""WITH {GRAPH}, {_CALLS} SELECT coalesce(x.b, y.a) AS key, coalesce(x.n, 0) AS callers, coalesce(y.n, 0) AS callees FROM (SELECT b, count(*) AS n FROM calls GROUP BY b) x FULL JOIN (SELECT a, count(*) AS n FROM calls GROUP BY a) y ON x.b = y.a""",
}
