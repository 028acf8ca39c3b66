"""Tables that queries derive from the given ones, where those hold no case of an operator.

A second state of every symbol (deleted, changed, renamed, moved, added by a hash of its key), and
intent claims laid upon current nodes. Both are made of whole tables, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.graph_queries import GRAPH
from lodestone.sources.graph import Graph

T1, T2 = 1000, 1500


def bucket(c: Column, m: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(m))


def bucket_sql(c: str, m: int) -> str:
    return f"(('0x' || substr(md5({c}), 1, 8))::BIGINT % {m})"


def symbols(graph: Graph) -> DataFrame:
    n = graph.nodes.filter("kind = 'code_symbol' and file_path is not null and symbol_kind is not null")
    return n.select(
        F.col("stable_key").alias("key"), F.split("stable_key", ":")[1].alias("language"), F.col("identifier").alias("canonical"), "name", F.col("symbol_kind").alias("kind"), "file_path", "signature",
        F.col("content_hash").alias("body"), F.col("content_hash").alias("shape"), bucket(F.col("stable_key"), 12).alias("b"),
    )


def later(sym: DataFrame) -> DataFrame:
    """The symbols after a change: b = 0 deleted, 1 body, 2 signature, 3 renamed, 4 moved, 5 layout, 6 one
    more added, 7 other owner, 8 moved to another owner."""
    b = F.col("b")
    on = lambda n, new, old: F.when(b.isin(*n), new).otherwise(old)
    c = F.col
    kept = sym.filter(b != 0).select(
        "key", "language", on([3], F.concat("canonical", F.lit("_r")), on([7, 8], F.concat("canonical", F.lit("."), "name"), c("canonical"))).alias("canonical"), on([3], F.concat("name", F.lit("_r")), c("name")).alias("name"), "kind",
        on([4, 8], F.concat("file_path", F.lit(".moved")), c("file_path")).alias("file_path"), on([2], F.concat("signature", F.lit(" -> x")), c("signature")).alias("signature"),
        on([1, 5], F.concat("body", F.lit("x")), c("body")).alias("body"), on([1], F.concat("shape", F.lit("x")), c("shape")).alias("shape"),
    )
    new = sym.filter(b == 6).select(
        F.concat("key", F.lit("_new")).alias("key"), "language", F.concat("canonical", F.lit("_new")).alias("canonical"), F.concat("name", F.lit("_new")).alias("name"), "kind", "file_path", "signature",
        F.concat("body", F.lit("n")).alias("body"), F.concat("shape", F.lit("n")).alias("shape"),
    )
    return kept.unionByName(new)


def file_changes(sym: DataFrame, after: DataFrame) -> DataFrame:
    """(op, old_path, new_path) of the files whose symbols differ."""
    state = lambda df, n: df.groupBy("file_path").agg(F.array_sort(F.collect_set(F.struct("canonical", "kind", F.coalesce("signature", F.lit("-")).alias("s"), "body"))).alias(n))
    j = state(sym, "b").join(state(after, "a"), "file_path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    op = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").otherwise("modified")
    return j.select(op.alias("op"), F.when(op != "added", F.col("file_path")).alias("old_path"), F.when(op != "deleted", F.col("file_path")).alias("new_path"))


def claims(graph: Graph) -> DataFrame:
    """(src, dst, kind, status, confidence_bp, evidence_bp): intent claims between current symbols and intents."""
    n = graph.nodes
    pick = lambda df, m, name: df.groupBy(bucket(F.col("stable_key"), m).alias(f"{name}_b")).agg(F.min("stable_key").alias(name))
    code = pick(n.filter("kind = 'code_symbol' and symbol_kind <> 'test' and file_path is not null"), 97, "symbol")
    intent = pick(n.filter("kind in ('feature', 'requirement', 'invariant', 'decision')"), 31, "intent")
    test = pick(n.filter("is_test"), 13, "test")
    e = graph.edges.filter("kind in ('implements', 'enforces', 'satisfies', 'depends_on', 'covered_by')").select(
        "kind", "status", "confidence_bp", bucket(F.col("fingerprint"), 97).alias("symbol_b"), bucket(F.col("fingerprint"), 31).alias("intent_b"), bucket(F.col("fingerprint"), 13).alias("test_b")
    )
    j = e.join(code, "symbol_b").join(intent, "intent_b").join(test, "test_b")
    covers = F.col("kind") == "covered_by"
    both = j.select(F.inline(F.array(
        F.struct(F.when(covers, F.col("intent")).otherwise(F.col("symbol")).alias("src"), F.when(covers, F.col("test")).otherwise(F.col("intent")).alias("dst"), "kind", "status", "confidence_bp"),
        F.struct(F.col("symbol").alias("src"), F.when(covers, F.col("test")).otherwise(F.col("intent")).alias("dst"), "kind", "status", "confidence_bp"),
    )))
    return both.distinct().withColumn("evidence_bp", F.lit(8000))


def grafted(graph: Graph) -> Graph:
    """The graph with the claims laid upon it: the columns that traversals read."""
    kept = ["src", "dst", "kind", "claim_class", "status", "confidence_bp", "fingerprint", "stale_reason"]
    own = claims(graph).select("src", "dst", "kind", F.lit("assertion").alias("claim_class"), "status", "confidence_bp", F.concat_ws(":", "src", "kind", "dst").alias("fingerprint"), F.lit(None).cast("string").alias("stale_reason"))
    return Graph(graph.nodes, graph.edges.select(*kept).unionByName(own))


SYM = f"""sym AS (SELECT stable_key AS key, string_split(stable_key, ':')[2] AS language, identifier AS canonical, name, symbol_kind AS kind, file_path, signature, content_hash AS body, content_hash AS shape,
 {bucket_sql('stable_key', 12)} AS b FROM n WHERE kind = 'code_symbol' AND file_path IS NOT NULL AND symbol_kind IS NOT NULL),
 nxt AS (SELECT key, language, CASE WHEN b = 3 THEN canonical || '_r' WHEN b IN (7, 8) THEN canonical || '.' || name ELSE canonical END AS canonical, CASE WHEN b = 3 THEN name || '_r' ELSE name END AS name, kind,
 CASE WHEN b IN (4, 8) THEN file_path || '.moved' ELSE file_path END AS file_path, CASE WHEN b = 2 THEN signature || ' -> x' ELSE signature END AS signature,
 CASE WHEN b IN (1, 5) THEN body || 'x' ELSE body END AS body, CASE WHEN b = 1 THEN shape || 'x' ELSE shape END AS shape FROM sym WHERE b <> 0
 UNION ALL SELECT key || '_new', language, canonical || '_new', name || '_new', kind, file_path, signature, body || 'n', shape || 'n' FROM sym WHERE b = 6)"""
CLAIMS = f"""pick_s AS (SELECT {bucket_sql('stable_key', 97)} AS sb, min(stable_key) AS symbol FROM n WHERE kind = 'code_symbol' AND symbol_kind <> 'test' AND file_path IS NOT NULL GROUP BY 1),
 pick_i AS (SELECT {bucket_sql('stable_key', 31)} AS ib, min(stable_key) AS intent FROM n WHERE kind IN ('feature','requirement','invariant','decision') GROUP BY 1),
 pick_t AS (SELECT {bucket_sql('stable_key', 13)} AS tb, min(stable_key) AS test FROM n WHERE is_test GROUP BY 1),
 cj AS (SELECT * FROM (SELECT kind, status, confidence_bp, {bucket_sql('fingerprint', 97)} AS sb, {bucket_sql('fingerprint', 31)} AS ib, {bucket_sql('fingerprint', 13)} AS tb FROM e
 WHERE kind IN ('implements','enforces','satisfies','depends_on','covered_by')) JOIN pick_s USING (sb) JOIN pick_i USING (ib) JOIN pick_t USING (tb)),
 gcl AS (SELECT DISTINCT CASE WHEN kind = 'covered_by' THEN intent ELSE symbol END AS src, CASE WHEN kind = 'covered_by' THEN test ELSE intent END AS dst, kind, status, confidence_bp FROM cj
 UNION SELECT DISTINCT symbol, CASE WHEN kind = 'covered_by' THEN test ELSE intent END, kind, status, confidence_bp FROM cj)"""
ENTITIES = """sm AS (SELECT file_path, b, a FROM sym b JOIN nxt a USING (file_path, canonical)), lb AS (SELECT * FROM sym b WHERE NOT EXISTS (SELECT 1 FROM nxt a WHERE a.file_path = b.file_path AND a.canonical = b.canonical)),
 ra AS (SELECT * FROM nxt a WHERE NOT EXISTS (SELECT 1 FROM sym b WHERE a.file_path = b.file_path AND a.canonical = b.canonical)),
 lk AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind, shape ORDER BY canonical) AS k FROM lb), rk AS (SELECT *, row_number() OVER (PARTITION BY file_path, kind, shape ORDER BY canonical) AS k FROM ra),
 pr AS (SELECT b.file_path, b.key AS bkey, a.key AS akey, b.canonical AS bc, a.canonical AS ac, b.signature AS bs, a.signature AS asg, b.body AS bb, a.body AS ab, b.shape AS bh, a.shape AS ah, true AS hb, true AS ha FROM sym b JOIN nxt a USING (file_path, canonical)
 UNION ALL SELECT coalesce(b.file_path, a.file_path), b.key, a.key, b.canonical, a.canonical, b.signature, a.signature, b.body, a.body, b.shape, a.shape, b.key IS NOT NULL, a.key IS NOT NULL
 FROM lk b FULL JOIN rk a ON a.file_path = b.file_path AND a.kind = b.kind AND a.shape = b.shape AND a.k = b.k),
 en0 AS (SELECT file_path, coalesce(bkey, akey) AS stable_key, bc AS old, ac AS new, CASE WHEN NOT hb OR NOT ha THEN 'behavior_potentially_changed' WHEN bs IS DISTINCT FROM asg THEN 'contract_changed' WHEN bc <> ac AND bh = ah THEN 'rename'
 WHEN bb = ab THEN 'refactor_likely' WHEN bh = ah THEN 'formatting_only' ELSE 'behavior_potentially_changed' END AS change FROM pr WHERE NOT hb OR NOT ha OR bb <> ab OR bs IS DISTINCT FROM asg OR bc <> ac),
 mv AS (SELECT stable_key, max(old) FILTER (new IS NULL) AS gone, max((new, file_path)) FILTER (old IS NULL) AS come FROM en0 GROUP BY stable_key HAVING count(*) = 2 AND max(old) FILTER (new IS NULL) IS NOT NULL AND max((new, file_path)) FILTER (old IS NULL) IS NOT NULL),
 en AS (SELECT * FROM en0 WHERE stable_key NOT IN (SELECT stable_key FROM mv) UNION ALL SELECT come[2], stable_key, gone, come[1], 'rename' FROM mv)""".replace("sm AS (SELECT file_path, b, a FROM sym b JOIN nxt a USING (file_path, canonical)), ", "")
BASE = f"WITH {GRAPH}, {SYM}, {CLAIMS}"
