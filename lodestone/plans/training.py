"""Queries of the general training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import history, increments, orphans
from lodestone.session import read, scratch, together


HALF = "2025-01-01"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "p1")
    capture = increments.ChangeCapture(spark, root)
    sink = increments.KeyOffsetSink(spark, f"{root}/sink", increments.VERSION_SCHEMA, "comment_id", "fetch_id")
    tables = (read(spark, sf_dir, t) for t in ("jira_comments", "analyzed_inputs", "enrich_runs"))
    return increments.pending_comments(capture, sink, *tables)


def p1_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: one over the first half of the fetches that fails, then one over all rows.

    The second reads what came since and takes up again what the failed run left open, so it finds
    what a single run over everything would.
    """
    root = scratch(spark, "p1-second")
    capture = increments.ChangeCapture(spark, root)
    sink = increments.KeyOffsetSink(spark, f"{root}/sink", increments.VERSION_SCHEMA, "comment_id", "fetch_id")
    comments, ledger, runs = (read(spark, sf_dir, t) for t in ("jira_comments", "analyzed_inputs", "enrich_runs"))
    then = F.lit(HALF).cast("timestamp_ntz")
    unfinished = F.col("finished_at").isNull() | (F.col("finished_at") >= then)
    early = runs.filter(F.col("started_at") < then).withColumn("run_status", F.when(unfinished, "running").otherwise(F.col("run_status")))
    increments.pending_comments(capture, sink, comments.filter(F.col("fetched_at") < then), ledger.filter(F.col("analyzed_at") < then), early, run_id=-1)
    return increments.pending_comments(capture, sink, comments, ledger, runs, run_id=-2)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes, calls, ends = (read(spark, sf_dir, t) for t in ("edges", "nodes", "external_calls", "endpoints"))
    both = together(
        lambda: orphans.orphan_references(orphans.edge_references(edges), orphans.node_records(nodes)),
        lambda: orphans.orphan_references(orphans.call_references(calls), orphans.endpoint_records(ends), grain=orphans.DAY),
    )
    return both[0].unionByName(both[1])


def p2_orphaned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphaned keys of the edges from state kept over two deliveries, the later one by its deltas.

    Length of the closed orphaned stretches, where the first begins, whether one is open.
    """
    state = orphans.OrphanState(spark, scratch(spark, "p2-state"))
    early = F.col("recorded_at") < F.lit(HALF).cast("timestamp_ntz")

    def deltas(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return orphans.reference_deltas(edges).unionByName(orphans.existence_deltas(nodes))

    tables = [read(spark, sf_dir, t) for t in ("edges", "nodes")]
    before = [make(t.filter(early)) for make, t in zip((orphans.edge_references, orphans.node_records), tables)]
    after = [make(t) for make, t in zip((orphans.edge_references, orphans.node_records), tables)]
    state.apply(0, deltas(*before))
    now = state.apply(1, deltas(*(orphans.row_changes(b, a) for b, a in zip(before, after))))
    length = F.aggregate("bare", F.lit(0).cast("long"), lambda x, g: x + F.when(g.hi == orphans.ALWAYS, 0).otherwise(g.hi - g.lo))
    return now.select("key", "first", length.alias("length"), F.array_min(F.transform("bare", lambda g: g.lo)).alias("begins"), F.exists("bare", lambda g: g.hi == orphans.ALWAYS).alias("open"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.status_history(read(spark, sf_dir, "edge_snapshots"), read(spark, sf_dir, "index_snapshots"))


def p5_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "edge_snapshots")
    axis = history.axis_of(history.slots_of(read(spark, sf_dir, "index_snapshots")), rows)
    return history.bitemporal_ledger(history.assertions(rows, axis), False)


QUERIES = {"p1_found": p1_found, "p1_second_run": p1_second_run, "p2_found": p2_found, "p2_report": p2_report, "p2_orphaned_keys": p2_orphaned_keys, "p5_found": p5_found, "p5_ledger": p5_ledger}

_P1 = r"""
WITH v AS (
  SELECT comment_id, fetch_id, issue_key || '-comment-' || comment_id AS external_id,
         sha256(coalesce(body, '')) AS input_fingerprint,
         CAST(regexp_replace(replace(coalesce(updated, created), 'Z', '+00:00'), '([+-]\d\d)(\d\d)$', '\1:\2') AS TIMESTAMPTZ) AS moment
  FROM jira_comments
), cur AS (
  SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY moment DESC, fetch_id DESC) = 1
), known AS (
  SELECT a.external_id, a.input_fingerprint AS analysed
  FROM analyzed_inputs a JOIN enrich_runs r ON r.run_id = a.run_id AND r.run_status = 'succeeded'
  WHERE a.provider = 'jira' AND a.kind = 'comment'
  QUALIFY row_number() OVER (PARTITION BY a.external_id ORDER BY a.run_id DESC, a.ledger_id DESC) = 1
)
SELECT cur.comment_id, cur.input_fingerprint
FROM cur LEFT JOIN known USING (external_id)
WHERE analysed IS NULL OR analysed <> input_fingerprint
"""

_P2 = r"""
WITH n AS (
  SELECT DISTINCT regexp_replace(stable_key, '^\s+|\s+$', '', 'g') AS key, created_commit AS lo, coalesce(retired_commit, 1000000) AS hi FROM nodes
), born AS (SELECT key, min(lo) AS first FROM n GROUP BY key
), live AS (SELECT * FROM n WHERE hi > lo
), reach AS (
  SELECT key, lo, hi, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM live
), gap AS (
  SELECT key, coalesce(before, -1000000) AS glo, lo AS ghi FROM reach WHERE before IS NULL OR lo > before
  UNION ALL SELECT key, max(hi), 2000000 FROM live GROUP BY key
), e AS (
  SELECT DISTINCT edge_id, valid_from AS lo, coalesce(valid_to, 1000000) AS hi, strftime(recorded_at, '%Y-%m') AS period,
         unnest(['src', 'dst']) AS ref_field, unnest([src, dst]) AS raw FROM edges
), r AS (
  SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS key FROM e WHERE raw IS NOT NULL AND lo < hi
), edge_cases AS (
  SELECT DISTINCT 'edges' AS ref_table, ref_field, edge_id AS row_id,
         CASE WHEN first IS NULL THEN 'missing' WHEN first > r.lo THEN 'late' ELSE 'deleted' END AS reason, period
  FROM r LEFT JOIN born USING (key) LEFT JOIN gap ON gap.key = r.key AND glo < r.hi AND ghi > r.lo
  WHERE r.key <> '' AND (first IS NULL OR glo IS NOT NULL OR NOT EXISTS (SELECT 1 FROM live WHERE live.key = r.key))
), c AS (
  SELECT DISTINCT call_id, method, recorded_at,
         regexp_replace(coalesce(path_template, CASE WHEN url ~ '^https?://' THEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END), '/\{[^/]*\}', '/{param}', 'g') AS path
  FROM external_calls
), p AS (
  SELECT method, regexp_replace(path, '/\{[^/]*\}', '/{param}', 'g') AS path, published_at, withdrawn_at FROM endpoints
), j AS (
  SELECT c.call_id, c.recorded_at, min(published_at) AS first,
         coalesce(bool_or(published_at <= c.recorded_at AND (withdrawn_at IS NULL OR c.recorded_at < withdrawn_at)), false) AS resolved
  FROM c LEFT JOIN p USING (method, path) WHERE c.path IS NOT NULL GROUP BY ALL
)
SELECT * FROM edge_cases
UNION ALL
SELECT 'external_calls', 'path_template', call_id,
       CASE WHEN first IS NULL THEN 'missing' WHEN first > recorded_at THEN 'late' ELSE 'deleted' END, strftime(recorded_at, '%Y-%m')
FROM j WHERE NOT resolved
"""

_P2_KEYS = r"""
WITH e AS (SELECT edge_id, valid_from AS lo, valid_to AS hi, unnest([src, dst]) AS raw FROM edges WHERE valid_to IS NULL OR valid_to > valid_from),
r AS (SELECT DISTINCT edge_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS key, lo, hi FROM e),
n AS (SELECT DISTINCT regexp_replace(stable_key, '^\s+|\s+$', '', 'g') AS key, created_commit AS lo, retired_commit AS hi FROM nodes),
d AS (SELECT key, lo AS p, 1 AS refs, 0 AS live FROM r UNION ALL SELECT key, hi, -1, 0 FROM r WHERE hi IS NOT NULL
 UNION ALL SELECT key, lo, 0, 1 FROM n WHERE hi IS NULL OR hi > lo UNION ALL SELECT key, hi, 0, -1 FROM n WHERE hi > lo),
s AS (SELECT key, p, sum(refs) AS refs, sum(live) AS live FROM d WHERE key <> '' GROUP BY key, p),
w AS (SELECT key, p, sum(refs) OVER o AS refs, sum(live) OVER o AS live, lead(p) OVER (PARTITION BY key ORDER BY p) AS next FROM s WINDOW o AS (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING)),
b AS (SELECT key, sum(coalesce(next - p, 0))::BIGINT AS length, min(p) AS begins, bool_or(next IS NULL) AS open FROM w WHERE refs > 0 AND live <= 0 GROUP BY key)
SELECT b.*, f.first FROM b LEFT JOIN (SELECT key, min(lo) AS first FROM n GROUP BY key) f USING (key)
"""

_P5 = r"""
WITH cur AS (
  SELECT fingerprint, commit_seq AS slot, lower(trim(status)) AS status FROM edge_snapshots
  QUALIFY row_number() OVER (PARTITION BY fingerprint, commit_seq ORDER BY recorded_at DESC, status DESC NULLS LAST) = 1
), shown AS (
  SELECT fingerprint, slot, last_value(status IGNORE NULLS) OVER w AS status, lead(slot) OVER w0 AS next,
         (SELECT min(commit_seq) FROM index_snapshots i WHERE i.is_complete AND i.commit_seq > cur.slot) AS whole
  FROM cur WINDOW w0 AS (PARTITION BY fingerprint ORDER BY slot),
                  w AS (PARTITION BY fingerprint ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), gaps AS (
  SELECT *, CASE WHEN whole < coalesce(next, 1000000000) THEN whole END AS gone FROM shown WHERE status IS NOT NULL
), marked AS (
  SELECT *, CASE WHEN lag(status) OVER w IS NOT DISTINCT FROM status AND lag(gone) OVER w IS NULL THEN 0 ELSE 1 END AS fresh
  FROM gaps WINDOW w AS (PARTITION BY fingerprint ORDER BY slot)
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY fingerprint ORDER BY slot) AS run FROM marked)
SELECT fingerprint, any_value(status) AS status, min(slot) AS valid_from, arg_max(coalesce(gone, next, -1), slot) AS valid_to
FROM runs GROUP BY fingerprint, run
"""

_P5_LEDGER = """
WITH a AS (SELECT commit_seq FROM index_snapshots UNION SELECT commit_seq FROM edge_snapshots), nx AS (SELECT commit_seq, lead(commit_seq) OVER (ORDER BY commit_seq) AS valid_to FROM a)
SELECT fingerprint, status, commit_seq AS valid_from, valid_to, recorded_at AS recorded_from,
       lead(recorded_at) OVER w AS recorded_to, lead(commit_seq) OVER w IS NOT NULL AS superseded
FROM (SELECT DISTINCT fingerprint, commit_seq, lower(trim(status)) AS status, recorded_at FROM edge_snapshots) JOIN nx USING (commit_seq)
WINDOW w AS (PARTITION BY fingerprint, commit_seq ORDER BY recorded_at, status NULLS FIRST)
"""

ORACLE = {
    "p1_found": _P1,
    "p1_second_run": _P1,
    "p2_found": _P2,
    "p2_report": f"SELECT ref_table, ref_field, period, reason, count(*) AS orphans FROM ({_P2}) GROUP BY ALL",
    "p2_orphaned_keys": _P2_KEYS,
    "p5_found": _P5,
    "p5_ledger": _P5_LEDGER,
}
