"""Queries on change detection, history and incremental state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import diff, history
from lodestone.operators.orphans import clean_key, route
from lodestone.session import read
from lodestone.sources.graph import load

AS_OF = 1000
THEN, NOW = "2024-09-01 00:00:00", "2025-10-01 00:00:00"


def _shown(spark: SparkSession, d: str, nth: int) -> DataFrame:
    """The claims of the nth complete snapshot from the end, after corrections."""
    slot = history.complete(read(spark, d, "index_snapshots"), nth)[-1]
    rows = read(spark, d, "edge_snapshots").filter(F.col("commit_seq") == slot)
    last = rows.groupBy("fingerprint").agg(F.max(F.struct("recorded_at", "status", "confidence_bp", "producer", "stale_reason")).alias("c"))
    return last.select("fingerprint", F.lower(F.trim("c.status")).alias("status"), "c.confidence_bp", "c.producer", "c.stale_reason")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Claims added, deleted or modified between the last two complete snapshots."""
    return diff.snapshot_diff(_shown(spark, d, 2), _shown(spark, d, 1), ["fingerprint"], ["status", "confidence_bp", "producer"])


def column_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.column_changes(_shown(spark, d, 2), _shown(spark, d, 1), ["fingerprint"], ["status", "confidence_bp", "producer", "stale_reason"])


def layer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """What replacing each producer's layer of claims does: created, updated, closed or kept."""
    b = _shown(spark, d, 2).select("fingerprint", "producer", F.struct("status", "confidence_bp").alias("b"))
    a = _shown(spark, d, 1).select("fingerprint", "producer", F.struct("status", "confidence_bp").alias("a"))
    act = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "closed").when(F.col("a").eqNullSafe(F.col("b")), "kept").otherwise("updated")
    return b.join(a, ["fingerprint", "producer"], "full_outer").groupBy("producer", act.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of the third last complete snapshot merged with those of the two after it."""
    base, ours, theirs = (_shown(spark, d, n).select("fingerprint", F.coalesce("status", F.lit("")).alias("status")) for n in (3, 2, 1))
    return diff.three_way_merge(base, ours, theirs, "fingerprint", "status")


def scd2_close(spark: SparkSession, d: str) -> DataFrame:
    """Open claims of one fingerprint close where the next one begins."""
    edges = read(spark, d, "edges").select("repo", "fingerprint", "edge_id", "valid_from", "valid_to").distinct()
    order = Window.partitionBy("repo", "fingerprint").orderBy("valid_from", "edge_id")
    return edges.select("repo", "fingerprint", "edge_id", "valid_from", F.coalesce("valid_to", F.lead("valid_from").over(order)).alias("valid_to"))


def scd2_asof(spark: SparkSession, d: str) -> DataFrame:
    """Status of every claim as of one commit, from its history."""
    versions = history.status_history(read(spark, d, "edge_snapshots"), read(spark, d, "index_snapshots"))
    return versions.filter((F.col("valid_from") <= AS_OF) & ((F.col("valid_to") > AS_OF) | (F.col("valid_to") == history.OPEN))).select("fingerprint", "status")


def nodes_asof(spark: SparkSession, d: str) -> DataFrame:
    """Live nodes of each kind at every snapshot.

    Starts and ends are counted once per commit and summed along the axis: no range join.
    """
    nodes = read(spark, d, "nodes").select(clean_key(F.col("stable_key")).alias("key"), "kind", "created_commit", "retired_commit").distinct()
    live = nodes.filter(F.col("retired_commit").isNull() | (F.col("retired_commit") > F.col("created_commit")))
    up = live.groupBy("kind", F.col("created_commit").alias("at")).agg(F.count(F.lit(1)).alias("d"))
    down = live.filter("retired_commit is not null").groupBy("kind", F.col("retired_commit").alias("at")).agg((-F.count(F.lit(1))).alias("d"))
    marks = read(spark, d, "index_snapshots").select(F.col("commit_seq").alias("at")).distinct()
    kinds = nodes.select("kind").distinct()
    probes = kinds.join(F.broadcast(marks)).select("kind", "at", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("probe"))  # kinds and snapshots: fixed sizes
    moves = up.union(down).groupBy("kind", "at").agg(F.sum("d").alias("d")).withColumn("probe", F.lit(False))
    order = Window.partitionBy("kind").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return moves.unionByName(probes).select("kind", "at", "probe", F.sum("d").over(order).alias("live")).filter("probe").select("kind", F.col("at").alias("commit_seq"), "live")


def file_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each version of a path as a change: added or modified, with the hash before."""
    files = read(spark, d, "source_files").select("path", "commit_seq", "content_hash", "file_id").distinct()
    order = Window.partitionBy("path").orderBy("commit_seq", "file_id")
    before = F.lag("content_hash").over(order)
    op = F.when(F.row_number().over(order) == 1, "added").when(before.eqNullSafe(F.col("content_hash")), "unchanged").otherwise("modified")
    return files.select("path", "commit_seq", "file_id", op.alias("op"))


def copied_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the class of equal content it belongs to and the size of the class."""
    files = read(spark, d, "source_files").select("file_id", "path", "content_hash").distinct()
    classes = files.groupBy("content_hash").agg(F.min("path").alias("original"), F.countDistinct("path").alias("paths"))
    return files.join(classes, "content_hash").select("file_id", "original", "paths")


def analysis_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Files whose analysis version is not the newest and that no later version covers."""
    files = read(spark, d, "source_files").select("path", "analysis_version", "commit_seq").distinct()
    newest = files.agg(F.max("analysis_version").alias("v"))
    last = files.groupBy("path").agg(F.max(F.struct("commit_seq", "analysis_version")).alias("l"))
    return last.join(F.broadcast(newest)).filter("l.analysis_version <> v").select("path", F.lit("modified").alias("op"))  # newest: one row


def source_scope(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files that are no longer there, and files that are not indexed."""
    indexed = load(spark, d).nodes.filter("kind = 'file'").select(F.col("identifier").alias("path")).distinct()
    there = read(spark, d, "source_files").select("path").distinct()
    gone = indexed.join(there, "path", "left_anti").select("path", F.lit("deleted").alias("op"))
    return gone.union(there.join(indexed, "path", "left_anti").select("path", F.lit("added").alias("op")))


def _endpoints_at(spark: SparkSession, d: str, at: str) -> DataFrame:
    rows = read(spark, d, "endpoints").filter(
        (F.col("published_at") <= F.lit(at).cast("timestamp_ntz")) & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > F.lit(at).cast("timestamp_ntz")))
    )
    last = rows.groupBy("method", "path").agg(F.max_by(F.struct("params", "return_type", "framework"), F.struct("published_at", "source_repo", "handler")).alias("e"))
    return last.select("method", "path", "e.params", "e.return_type", "e.framework")


def api_changes(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints removed, added or changed in contract between two instants."""
    return diff.api_changes(_endpoints_at(spark, d, THEN), _endpoints_at(spark, d, NOW), ["method", "path"])


def change_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Kind of change between consecutive versions of each symbol.

    The node table keeps one hash of the body, so changes of layout alone count as changes of it.
    """
    v = read(spark, d, "nodes").filter("kind = 'code_symbol'").select(
        F.trim("stable_key").alias("k"), "identifier", "signature", "content_hash", "created_commit"
    ).distinct()
    order = Window.partitionBy("k").orderBy("created_commit", "content_hash")
    was = lambda c: F.lag(c).over(order)
    kind = diff.change_kind(
        {"path": was("identifier"), "signature": was("signature"), "body": was("content_hash"), "shape": was("content_hash")},
        {"path": F.col("identifier"), "signature": F.col("signature"), "body": F.col("content_hash"), "shape": F.col("content_hash")},
    )
    return v.select("k", "created_commit", "content_hash", kind.alias("change"))


def change_findings(spark: SparkSession, d: str) -> DataFrame:
    """Claims that back an intent with a symbol whose version changed, graded by the intent.

    Grouped by intent: gravest severity, greatest confidence, number of changed symbols.
    """
    graph = load(spark, d)
    changed = change_ladder(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("k").alias("src"))
    claims = graph.edges.filter("kind in ('implements', 'enforces', 'satisfies', 'depends_on') and status = 'active'").join(changed, "src", "left_semi")
    rank = F.when(F.col("node_kind").isin("invariant", "requirement"), 3).when(F.col("node_kind").isin("feature", "decision"), 2).otherwise(1)
    targets = graph.nodes.select(F.col("stable_key").alias("dst"), F.col("kind").alias("node_kind"))
    found = claims.join(targets, "dst").groupBy("dst").agg(F.max(rank).alias("rank"), F.max("confidence_bp").alias("confidence_bp"), F.countDistinct("src").alias("symbols"))
    return found.select("dst", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank")).alias("severity"), "confidence_bp", "symbols")


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index stands at the newest commit of each repository's claims."""
    head = read(spark, d, "edges").groupBy("repo").agg(F.max("valid_from").alias("head"))
    mark = read(spark, d, "index_snapshots").agg(F.max("commit_seq").alias("indexed"))
    state = F.when(F.col("indexed").isNull(), "not_indexed").when(F.col("indexed") >= F.col("head"), "current").otherwise("behind")
    return head.join(F.broadcast(mark)).select("repo", "head", state.alias("freshness"))  # mark: one row


def ledger_state(spark: SparkSession, d: str) -> DataFrame:
    """Inputs per provider, kind and state of the run that wrote them."""
    runs = read(spark, d, "enrich_runs").select("run_id", "run_status")
    ledger = read(spark, d, "analyzed_inputs").distinct().join(F.broadcast(runs), "run_id", "left")  # a table of fixed size
    return ledger.groupBy("provider", "kind", F.coalesce("run_status", F.lit("unknown")).alias("run_status")).agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("external_id").alias("inputs")
    )


def sync_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The cursor a next run starts from: that of the last run that succeeded."""
    runs = read(spark, d, "enrich_runs").filter("run_status = 'succeeded'")
    return runs.agg(F.max("run_id").alias("run_id"), F.max_by("cursor_value", "run_id").alias("cursor_value"))


def resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour that answers each call: its one live endpoint, ambiguous if several repositories offer it.

    Endpoints are joined by method and path shape; the instants are compared after the join.
    """
    calls = read(spark, d, "external_calls").filter("path_template is not null").select("call_id", route(F.col("method"), F.col("path_template")).alias("route"), "recorded_at").distinct()
    ends = read(spark, d, "endpoints").select(route(F.col("method"), F.col("path")).alias("route"), "source_repo", "published_at", "withdrawn_at")
    live = (F.col("published_at") <= F.col("recorded_at")) & (F.col("withdrawn_at").isNull() | (F.col("withdrawn_at") > F.col("recorded_at")))
    hits = calls.join(ends, "route").filter(live).groupBy("call_id").agg(F.countDistinct("source_repo").alias("n"), F.min("source_repo").alias("repo"))
    state = F.when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return hits.select("call_id", state.alias("state"), F.when(F.col("n") == 1, F.col("repo")).alias("neighbor"))


def ambiguous_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Method and path shapes that more than one repository offers."""
    ends = read(spark, d, "endpoints").groupBy(route(F.col("method"), F.col("path")).alias("route"))
    return ends.agg(F.countDistinct("source_repo").alias("repos"), F.array_join(F.array_sort(F.collect_set("source_repo")), ",").alias("names")).filter("repos > 1")


def endpoint_export(spark: SparkSession, d: str) -> DataFrame:
    """One row per offered method and path: all handlers, the newest contract."""
    ends = read(spark, d, "endpoints")
    return ends.groupBy("method", "path").agg(
        F.array_join(F.array_sort(F.collect_set("handler")), ",").alias("handlers"), F.max("published_at").alias("published_at"),
        F.max_by("framework", F.struct("published_at", "source_repo", "handler")).alias("framework"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_diff, column_diff, layer_reconcile, three_way_merge, scd2_close, scd2_asof, nodes_asof, file_versions, copied_files, analysis_refresh, source_scope,
        api_changes, change_ladder, change_findings, freshness, ledger_state, sync_cursor, resolutions, ambiguous_shapes, endpoint_export,
    )
}


def _shown_sql(name: str, nth: int) -> str:
    return f"""{name} AS (SELECT fingerprint, lower(trim(status)) AS status, confidence_bp, producer, stale_reason FROM edge_snapshots
 WHERE commit_seq = (SELECT commit_seq FROM index_snapshots WHERE is_complete ORDER BY commit_seq DESC LIMIT 1 OFFSET {nth - 1})
 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY recorded_at DESC) = 1)"""


def _api_sql(name: str, at: str) -> str:
    return f"""{name} AS (SELECT method, path, params, return_type, framework FROM endpoints WHERE published_at <= TIMESTAMP '{at}' AND (withdrawn_at IS NULL OR withdrawn_at > TIMESTAMP '{at}')
 QUALIFY row_number() OVER (PARTITION BY method, path ORDER BY published_at DESC, source_repo DESC, handler DESC) = 1)"""


_ROUTE = r"upper(method) || ' ' || regexp_replace({p}, '/\{{[^/]*\}}', '/{{param}}', 'g')"
_LADDER = """v AS (SELECT DISTINCT trim(stable_key) AS k, identifier, signature, content_hash, created_commit FROM nodes WHERE kind = 'code_symbol'),
 l AS (SELECT *, lag(identifier) OVER w AS i, lag(signature) OVER w AS s, lag(content_hash) OVER w AS h FROM v WINDOW w AS (PARTITION BY k ORDER BY created_commit, content_hash)),
 ladder AS (SELECT k, created_commit, content_hash, CASE WHEN i IS NULL OR identifier IS NULL THEN 'behavior_potentially_changed' WHEN s IS DISTINCT FROM signature THEN 'contract_changed'
 WHEN i <> identifier AND h = content_hash THEN 'rename' WHEN h = content_hash THEN 'refactor_likely' ELSE 'behavior_potentially_changed' END AS change FROM l)"""

from lodestone.plans.graph_queries import GRAPH  # noqa: E402
from lodestone.plans.training import _P5  # noqa: E402

ORACLE = {
    "snapshot_diff": f"""WITH {_shown_sql('b', 2)}, {_shown_sql('a', 1)} SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint,
 CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'deleted' ELSE 'modified' END AS op FROM b FULL JOIN a USING (fingerprint)
 WHERE a.fingerprint IS NULL OR b.fingerprint IS NULL OR (a.status, a.confidence_bp, a.producer) IS DISTINCT FROM (b.status, b.confidence_bp, b.producer)""",
    "column_diff": f"WITH {_shown_sql('b', 2)}, {_shown_sql('a', 1)} "
    + " UNION ALL ".join(
        f"SELECT fingerprint, '{c}' AS field, b.{c}::VARCHAR AS old, a.{c}::VARCHAR AS new FROM a JOIN b USING (fingerprint) WHERE a.{c} IS DISTINCT FROM b.{c}"
        for c in ("status", "confidence_bp", "producer", "stale_reason")
    ),
    "layer_reconcile": f"""WITH {_shown_sql('b', 2)}, {_shown_sql('a', 1)} SELECT producer, CASE WHEN b.confidence_bp IS NULL THEN 'created' WHEN a.confidence_bp IS NULL THEN 'closed'
 WHEN (a.status, a.confidence_bp) IS NOT DISTINCT FROM (b.status, b.confidence_bp) THEN 'kept' ELSE 'updated' END AS action, count(*) AS n FROM b FULL JOIN a USING (fingerprint, producer) GROUP BY ALL""",
    "three_way_merge": f"""WITH {_shown_sql('b', 3)}, {_shown_sql('o', 2)}, {_shown_sql('t', 1)},
 j AS (SELECT fingerprint, CASE WHEN b.producer IS NULL THEN '-' ELSE '+' || coalesce(b.status, '') END AS bv, CASE WHEN o.producer IS NULL THEN '-' ELSE '+' || coalesce(o.status, '') END AS ov,
 CASE WHEN t.producer IS NULL THEN '-' ELSE '+' || coalesce(t.status, '') END AS tv FROM b FULL JOIN o USING (fingerprint) FULL JOIN t USING (fingerprint)),
 k AS (SELECT *, CASE WHEN ov = bv AND tv = bv THEN 'unchanged' WHEN ov = tv THEN 'same' WHEN tv = bv THEN 'ours' WHEN ov = bv THEN 'theirs' ELSE 'ambiguous' END AS outcome FROM j)
 SELECT fingerprint, outcome, CASE WHEN outcome IN ('unchanged', 'same', 'ours') THEN CASE WHEN ov <> '-' THEN ov[2:] END WHEN outcome = 'theirs' THEN CASE WHEN tv <> '-' THEN tv[2:] END END AS merged FROM k""",
    "scd2_close": """SELECT repo, fingerprint, edge_id, valid_from, coalesce(valid_to, lead(valid_from) OVER (PARTITION BY repo, fingerprint ORDER BY valid_from, edge_id)) AS valid_to
 FROM (SELECT DISTINCT repo, fingerprint, edge_id, valid_from, valid_to FROM edges)""",
    "scd2_asof": f"SELECT fingerprint, status FROM ({_P5}) WHERE valid_from <= {AS_OF} AND (valid_to > {AS_OF} OR valid_to = -1)",
    "nodes_asof": """WITH v AS (SELECT DISTINCT trim(stable_key) AS k, kind, created_commit, retired_commit FROM nodes), s AS (SELECT DISTINCT commit_seq FROM index_snapshots)
 SELECT kind, commit_seq, count(k) FILTER (created_commit <= commit_seq AND (retired_commit IS NULL OR retired_commit > commit_seq)) AS live FROM v, s GROUP BY ALL""",
    "file_versions": """SELECT path, commit_seq, file_id, CASE WHEN row_number() OVER w = 1 THEN 'added' WHEN lag(content_hash) OVER w = content_hash THEN 'unchanged' ELSE 'modified' END AS op
 FROM (SELECT DISTINCT path, commit_seq, content_hash, file_id FROM source_files) WINDOW w AS (PARTITION BY path ORDER BY commit_seq, file_id)""",
    "copied_files": """WITH f AS (SELECT DISTINCT file_id, path, content_hash FROM source_files), c AS (SELECT content_hash, min(path) AS original, count(DISTINCT path) AS paths FROM f GROUP BY 1)
 SELECT file_id, original, paths FROM f JOIN c USING (content_hash)""",
    "analysis_refresh": """SELECT path, 'modified' AS op FROM (SELECT path, arg_max(analysis_version, (commit_seq, analysis_version)) AS v FROM source_files GROUP BY path) WHERE v <> (SELECT max(analysis_version) FROM source_files)""",
    "source_scope": f"""WITH {GRAPH}, i AS (SELECT DISTINCT identifier AS path FROM n WHERE kind = 'file'), t AS (SELECT DISTINCT path FROM source_files)
 SELECT path, 'deleted' AS op FROM i WHERE path NOT IN (SELECT path FROM t) UNION ALL SELECT path, 'added' FROM t WHERE path NOT IN (SELECT path FROM i)""",
    "api_changes": f"""WITH {_api_sql('b', THEN)}, {_api_sql('a', NOW)},
 j AS (SELECT coalesce(a.method, b.method) AS method, coalesce(a.path, b.path) AS path, a.method IS NULL AS gone, b.method IS NULL AS fresh,
 list_transform(b.params, lambda p: p.name) AS bn, list_transform(a.params, lambda p: p.name) AS an, b.params AS bp, a.params AS ap,
 b.return_type AS br, a.return_type AS ar, b.framework AS bf, a.framework AS af FROM b FULL JOIN a ON a.method = b.method AND a.path = b.path),
 k AS (SELECT *, list_sort(list_filter(bn, lambda x: NOT list_contains(an, x))) AS lost, list_sort(list_filter(an, lambda x: NOT list_contains(bn, x))) AS new,
 list_sort(list_transform(list_filter(bp, lambda p: list_contains(an, p.name) AND NOT list_contains(ap, p)), lambda p: p.name)) AS moved FROM j),
 m AS (SELECT *, list_concat(list_concat(list_transform(lost, lambda x: 'removed parameter ' || x), list_transform(moved, lambda x: 'changed parameter ' || x)), list_concat(list_transform(new, lambda x: 'added parameter ' || x),
 list_filter([CASE WHEN br IS DISTINCT FROM ar THEN 'return type changed from ' || coalesce(br, 'unknown') || ' to ' || coalesce(ar, 'unknown') END, CASE WHEN bf <> af THEN 'framework changed from ' || bf || ' to ' || af END], lambda x: x IS NOT NULL))) AS det FROM k)
 SELECT method, path, CASE WHEN gone THEN 'removed' WHEN fresh THEN 'added' ELSE 'contract_modified' END AS kind,
 gone OR (NOT fresh AND (len(lost) > 0 OR len(moved) > 0 OR (br IS NOT NULL AND br IS DISTINCT FROM ar))) AS destructive, CASE WHEN gone OR fresh THEN '' ELSE array_to_string(det, '; ') END AS details
 FROM m WHERE gone OR fresh OR len(det) > 0""",
    "change_ladder": f"WITH {_LADDER} SELECT * FROM ladder",
    "change_findings": f"""WITH {GRAPH}, {_LADDER}, ch AS (SELECT k FROM ladder GROUP BY k HAVING count(*) > 1)
 SELECT dst, CASE WHEN n.kind IN ('invariant','requirement') THEN 'high' WHEN n.kind IN ('feature','decision') THEN 'medium' ELSE 'low' END AS severity, max(e.confidence_bp) AS confidence_bp, count(DISTINCT src) AS symbols
 FROM e JOIN n ON n.stable_key = dst WHERE e.kind IN ('implements','enforces','satisfies','depends_on') AND e.status = 'active' AND src IN (SELECT k FROM ch) GROUP BY 1, 2""",
    "freshness": """SELECT repo, max(valid_from) AS head, CASE WHEN (SELECT max(commit_seq) FROM index_snapshots) IS NULL THEN 'not_indexed'
 WHEN (SELECT max(commit_seq) FROM index_snapshots) >= max(valid_from) THEN 'current' ELSE 'behind' END AS freshness FROM edges GROUP BY repo""",
    "ledger_state": """SELECT provider, kind, coalesce(run_status, 'unknown') AS run_status, count(*) AS entries, count(DISTINCT external_id) AS inputs
 FROM (SELECT DISTINCT * FROM analyzed_inputs) LEFT JOIN enrich_runs USING (run_id) GROUP BY 1, 2, 3""",
    "sync_cursor": "SELECT max(run_id) AS run_id, arg_max(cursor_value, run_id) AS cursor_value FROM enrich_runs WHERE run_status = 'succeeded'",
    "resolutions": f"""WITH c AS (SELECT DISTINCT call_id, {_ROUTE.format(p='path_template')} AS route, recorded_at FROM external_calls WHERE path_template IS NOT NULL),
 p AS (SELECT {_ROUTE.format(p='path')} AS route, source_repo, published_at, withdrawn_at FROM endpoints)
 SELECT call_id, CASE WHEN count(DISTINCT source_repo) > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN count(DISTINCT source_repo) = 1 THEN min(source_repo) END AS neighbor
 FROM c JOIN p USING (route) WHERE published_at <= recorded_at AND (withdrawn_at IS NULL OR withdrawn_at > recorded_at) GROUP BY call_id""",
    "ambiguous_shapes": f"""SELECT {_ROUTE.format(p='path')} AS route, count(DISTINCT source_repo) AS repos, string_agg(DISTINCT source_repo, ',' ORDER BY source_repo) AS names FROM endpoints GROUP BY 1 HAVING count(DISTINCT source_repo) > 1""",
    "endpoint_export": """SELECT method, path, string_agg(DISTINCT handler, ',' ORDER BY handler) AS handlers, max(published_at) AS published_at, arg_max(framework, (published_at, source_repo, handler)) AS framework
 FROM endpoints GROUP BY method, path""",
}
