"""Queries on reviews and the incremental planner, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import diff, graph as g, planner, review
from lodestone.operators.orphans import clean_key
from lodestone.plans import derived as dv
from lodestone.plans.change_queries import api_changes
from lodestone.session import materialise, read
from lodestone.sources.graph import Graph, load


def _entities(graph: Graph) -> DataFrame:
    sym = dv.symbols(graph)
    return review.changed_entities(sym, dv.later(sym))


def changed_entities(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the derived second state that are not as before, moves between files merged."""
    return _entities(load(spark, d))


def change_signals(spark: SparkSession, d: str) -> DataFrame:
    """Changed symbols by kind of change, and how many of them a review leaves out."""
    rows = _entities(load(spark, d))
    return rows.groupBy("change").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("change").isin(*review.SILENT)).alias("silent"))


def _direct(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    entities = materialise(_entities(graph), "entities")
    claims = materialise(dv.claims(graph), "claims")
    return entities, claims, review.direct_findings(entities, claims, graph.nodes)


def review_findings(spark: SparkSession, d: str) -> DataFrame:
    """Changes that reach an intent, with what a reviewer should do."""
    graph = load(spark, d)
    _, _, found = _direct(graph)
    return found.drop("via").withColumn("action", review.suggested_action(F.col("intent_kind"), F.lit(False)))


def indirect_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings at the callers of changed functions."""
    graph = load(spark, d)
    entities, claims, direct = _direct(graph)
    return review.indirect_findings(entities, claims, graph.nodes, g.callers(graph), direct)


def review_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each rule would fail the derived change."""
    _, _, found = _direct(load(spark, d))
    return review.blocked(found, api_changes(spark, d).select("destructive"))


def _accesses(spark: SparkSession, d: str, at: int) -> DataFrame:
    e = read(spark, d, "edges").filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    from lodestone.model import relation

    rows = e.select(clean_key(F.col("src")).alias("symbol"), relation(F.col("kind")).alias("kind"), clean_key(F.col("dst")).alias("target")).filter("kind in ('reads_from', 'writes_to')")
    return rows.dropna().distinct()


def access_signals(spark: SparkSession, d: str) -> DataFrame:
    """What each symbol read or wrote at one commit and another, where it differs."""
    return review.access_signals(_accesses(spark, d, dv.T1), _accesses(spark, d, dv.T2))


def api_findings(spark: SparkSession, d: str) -> DataFrame:
    """Changed endpoints with the intents and tests around the symbols behind them."""
    graph = load(spark, d)
    changes = api_changes(spark, d)
    entity = F.concat("method", F.lit(" "), "path")
    rows = changes.select(entity.alias("entity"), "destructive", review.api_description(F.col("kind"), F.col("method"), F.col("path"), F.col("details")).alias("text"))
    claims = dv.claims(graph)
    at = claims.select(F.col("src").alias("symbol"), dv.bucket(F.col("src"), 7).alias("b")).distinct()
    touching = changes.select(entity.alias("entity"), dv.bucket(entity, 7).alias("b")).join(at, "b").select("entity", "symbol")
    return review.findings_of_changes(rows, touching, claims, graph.nodes)


def _columns(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Columns of every table before and after a derived migration."""
    t = graph.nodes.filter("kind = 'db_entity'").select(F.col("identifier").alias("entity"), dv.bucket(F.col("identifier"), 7).alias("b"))
    col = lambda name, kind, null, pk: F.struct(F.lit(name).alias("name"), kind.alias("data_type"), null.cast("boolean").alias("nullable"), F.lit(pk).alias("primary_key"), F.lit(False).alias("unique"), F.lit(None).cast("string").alias("foreign_key"), F.lit(None).cast("string").alias("default"))
    b = F.col("b")
    text, whole = F.lit("text"), F.lit("int")
    before = t.select("entity", F.inline(F.array(col("id", F.lit("bigint"), F.lit(False), True), col("note", text, F.lit(True), False), col("amount", whole, F.lit(None), False))))
    rows = F.array_compact(F.array(
        col("id", F.lit("bigint"), F.lit(False), True), F.when(b != 0, col("note", text, b != 2, False)),
        col("amount", F.when(b == 1, F.lit("bigint")).otherwise(whole), F.when(b == 4, F.lit(True)), False), F.when(b == 3, col("extra", text, F.lit(True), False)),
    ))
    return before, t.select("entity", F.inline(rows))


def schema_findings(spark: SparkSession, d: str) -> DataFrame:
    """Changed tables with the intents and tests around the code that reads, writes or declares them."""
    graph = load(spark, d)
    changes = diff.schema_changes(*_columns(graph))
    rows = changes.select("entity", "destructive", review.schema_description(F.col("change"), F.col("entity"), F.col("column")).alias("text"))
    claims = dv.claims(graph)
    at = claims.select(F.col("src").alias("symbol"), dv.bucket(F.col("src"), 11).alias("b")).distinct()
    touching = changes.select("entity", dv.bucket(F.col("entity"), 11).alias("b")).distinct().join(at, "b").select("entity", "symbol")
    return review.findings_of_changes(rows, touching, claims, graph.nodes)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    graph = load(spark, d)
    sym = materialise(dv.symbols(graph), "prior")
    after = materialise(dv.later(sym), "after")
    changes = materialise(dv.file_changes(sym, after), "changes")
    touched = changes.filter("new_path is not null").select(F.col("new_path").alias("file_path"))
    defs = after.drop("key").join(touched, "file_path", "left_semi").withColumn("ord", F.concat_ws("|", "file_path", "canonical", "kind"))
    planned = materialise(planner.plan_symbols(sym, defs, changes), "planned")
    return sym, defs, changes, planned


def index_plan(spark: SparkSession, d: str) -> DataFrame:
    """The identity every definition of the changed files gets."""
    return _plan(spark, d)[3].drop("ord")


def index_retired(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that no definition of the changed files takes over."""
    sym, _, changes, planned = _plan(spark, d)
    return planner.retired(sym, planned, changes)


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    sym, _, changes, planned = _plan(spark, d)
    return planner.summary(planned, planner.retired(sym, planned, changes), changes.filter("new_path is not null"))


def collision_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that all symbols would get if their name alone made them."""
    sym = dv.symbols(load(spark, d)).withColumn("base", planner.symbol_key(F.col("language"), F.lower(F.substring("name", 1, 6)), F.col("kind")))
    return planner.numbered_keys(sym.withColumnRenamed("key", "stable_key"), "base", ["stable_key"]).select("stable_key", "key")


def entity_facts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of tables that the accesses of one commit and another create or retire."""
    side = lambda at: _accesses(spark, d, at).select("target")
    return planner.entity_facts(side(dv.T1), side(dv.T2), "target")


def call_nodes(spark: SparkSession, d: str) -> DataFrame:
    """External calls that appear or vanish between the two halves of the record."""
    calls = read(spark, d, "external_calls").select(F.trim("stable_key").alias("key"), "recorded_at")
    half = F.lit("2025-01-01").cast("timestamp_ntz")
    return planner.entity_facts(calls.filter(F.col("recorded_at") < half), calls.filter(F.col("recorded_at") >= half), "key")


def cross_file_moves(spark: SparkSession, d: str) -> DataFrame:
    """Moves between files among the derived changes."""
    sym = dv.symbols(load(spark, d))
    both = review.changed_entities(sym, dv.later(sym)).filter("change = 'rename'").join(sym.select(F.col("key").alias("stable_key"), F.col("file_path").alias("was")), "stable_key")
    return both.filter("file_path <> was").select("stable_key", "was", "file_path", "new")


QUERIES = {
    f.__name__: f
    for f in (
        changed_entities, change_signals, review_findings, indirect_findings, review_gate, access_signals, api_findings, schema_findings, index_plan, index_retired, index_summary, collision_keys, entity_facts,
        call_nodes, cross_file_moves,
    )
}

from lodestone.plans.change_queries import ORACLE as _CHANGE  # noqa: E402
from lodestone.plans.graph_queries import _CALLS, _KIND, GRAPH  # noqa: E402

_BASE = f"{dv.BASE}, {dv.ENTITIES}"
_GRADE = "CASE WHEN intent_kind IN ('invariant','requirement') THEN 'high' WHEN intent_kind IN ('feature','decision') THEN 'medium' ELSE 'low' END"
_BP = "least(CASE WHEN change = 'contract_changed' THEN 10000 ELSE 9000 END, claim_bp)"
_FOUND = f"""bk AS (SELECT DISTINCT src, dst, n.kind AS intent_kind, least(confidence_bp, 8000) AS claim_bp FROM gcl JOIN n ON n.stable_key = dst WHERE gcl.kind IN ('implements','enforces','satisfies','depends_on') AND gcl.status = 'active' AND n.kind IN ('feature','requirement','invariant','decision')),
 loud AS (SELECT DISTINCT stable_key AS src, change, coalesce(new, old) AS changed FROM en WHERE change NOT IN ('formatting_only','rename','refactor_likely')),
 df AS (SELECT changed, src AS source, dst AS intent, intent_kind, change, {_GRADE} AS severity, {_BP} AS confidence_bp FROM loud JOIN bk USING (src) WHERE {_BP} >= 6500)"""
_INDIRECT = f"""{_CALLS}, ind AS (SELECT x.identifier AS changed, x.stable_key AS source, bk.dst AS intent, intent_kind, change, {_GRADE} AS severity, {_BP} AS confidence_bp, loud.changed AS via
 FROM loud JOIN n h ON h.stable_key = loud.src AND h.kind = 'code_symbol' AND h.symbol_kind IN ('function','method') JOIN calls ON b = loud.src JOIN n x ON x.stable_key = a AND NOT x.is_test JOIN bk ON bk.src = a WHERE {_BP} >= 6500)
 SELECT changed, source, intent, intent_kind, change, severity, confidence_bp, via FROM ind WHERE (source, intent) NOT IN (SELECT (source, intent) FROM df)
 QUALIFY row_number() OVER (PARTITION BY source, intent ORDER BY length(via) DESC, via, change, confidence_bp) = 1"""
_ACTION = " ".join(f"WHEN '{k}' THEN 'Verify the {k} still holds and review the unchanged related tests.'" for k in ("invariant", "requirement"))
_SIDE = lambda name, at: f"{name} AS (SELECT DISTINCT trim(src) AS symbol, {_KIND.format(k='kind')} AS kind, trim(dst) AS target FROM edges WHERE valid_from <= {at} AND (valid_to IS NULL OR valid_to > {at}) AND trim(src) <> '' AND trim(dst) <> '')"
_ACCESS = f"WITH {_SIDE('x0', dv.T1)}, {_SIDE('y0', dv.T2)}, x AS (SELECT * FROM x0 WHERE kind IN ('reads_from','writes_to')), y AS (SELECT * FROM y0 WHERE kind IN ('reads_from','writes_to'))"
_AROUND = """SELECT own.entity, own.destructive, own.changes, coalesce(string_agg(DISTINCT m.identifier, ',' ORDER BY m.identifier) FILTER (c.kind IN ('implements','enforces','satisfies')), '') AS intents,
 coalesce(string_agg(DISTINCT m.identifier, ',' ORDER BY m.identifier) FILTER (c.kind = 'covered_by' AND m.is_test), '') AS tests FROM own LEFT JOIN tou ON tou.entity = own.entity LEFT JOIN (SELECT * FROM gcl WHERE status = 'active') c ON c.src = tou.symbol
 LEFT JOIN n m ON m.stable_key = c.dst GROUP BY ALL"""
_NAMED = f"""{_BASE}, fs AS (SELECT coalesce(b.file_path, a.file_path) AS file_path, b.s AS bs, a.s AS s FROM (SELECT file_path, list_sort(list((canonical, kind, coalesce(signature, '-'), body))) AS s FROM (SELECT DISTINCT file_path, canonical, kind, signature, body FROM sym) GROUP BY 1) b
 FULL JOIN (SELECT file_path, list_sort(list((canonical, kind, coalesce(signature, '-'), body))) AS s FROM (SELECT DISTINCT file_path, canonical, kind, signature, body FROM nxt) GROUP BY 1) a ON a.file_path = b.file_path),
 ch AS (SELECT file_path, bs IS NULL AS added, s IS NULL AS deleted FROM fs WHERE s IS DISTINCT FROM bs), df0 AS (SELECT *, file_path || '|' || canonical || '|' || kind AS ord FROM nxt WHERE file_path IN (SELECT file_path FROM ch WHERE NOT deleted)),
 ux AS (SELECT language, canonical, kind, min(key) AS exact FROM sym GROUP BY 1, 2, 3 HAVING count(*) = 1), un AS (SELECT file_path, name, kind, coalesce(signature, '') AS sig, min(key) AS named FROM sym GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
 us AS (SELECT language, kind, name, shape, min(key) AS shaped FROM sym WHERE file_path IN (SELECT file_path FROM ch WHERE NOT added) GROUP BY 1, 2, 3, 4 HAVING count(*) = 1),
 go AS (SELECT file_path, kind, shape, min(key) AS renamed FROM sym s WHERE NOT EXISTS (SELECT 1 FROM df0 d WHERE d.file_path = s.file_path AND d.canonical = s.canonical) GROUP BY 1, 2, 3 HAVING count(*) = 1),
 nw AS (SELECT file_path, kind, shape, min(ord) AS ord FROM df0 d WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE d.file_path = s.file_path AND d.canonical = s.canonical) GROUP BY 1, 2, 3 HAVING count(*) = 1),
 rn AS (SELECT ord, renamed FROM nw JOIN go USING (file_path, kind, shape)),
 cd AS (SELECT d.*, exact, named, shaped, renamed FROM df0 d LEFT JOIN ux USING (language, canonical, kind) LEFT JOIN un ON un.file_path = d.file_path AND un.name = d.name AND un.kind = d.kind AND un.sig = coalesce(d.signature, '')
 LEFT JOIN us ON us.language = d.language AND us.kind = d.kind AND us.name = d.name AND us.shape = d.shape LEFT JOIN rn ON rn.ord = d.ord),
 rs AS (SELECT DISTINCT exact FROM cd WHERE exact IS NOT NULL), fr AS (SELECT *, CASE WHEN named IS NOT NULL AND named NOT IN (SELECT exact FROM rs) THEN named WHEN shaped IS NOT NULL AND shaped NOT IN (SELECT exact FROM rs) THEN shaped WHEN renamed IS NOT NULL AND renamed NOT IN (SELECT exact FROM rs) THEN renamed END AS wish FROM cd),
 tk AS (SELECT *, CASE WHEN wish IS NOT NULL AND row_number() OVER (PARTITION BY wish ORDER BY ord) = 1 THEN wish END AS got FROM fr),
 ky AS (SELECT *, 'symbol:' || language || ':' || canonical || ':' || upper(kind[1]) || kind[2:] AS base, coalesce(exact, named, shaped, renamed) IS NOT NULL AS matched FROM tk),
 sp AS (SELECT DISTINCT coalesce(got, exact, base) AS base FROM ky WHERE matched), pl AS (SELECT ky.*, CASE WHEN matched THEN coalesce(got, ky.base) ELSE ky.base || CASE WHEN place = 1 THEN '' ELSE '#' || place END END AS k FROM
 (SELECT ky.*, row_number() OVER (PARTITION BY matched, ky.base ORDER BY ord) + CASE WHEN sp.base IS NULL THEN 0 ELSE 1 END AS place FROM ky LEFT JOIN sp ON sp.base = ky.base) ky),
 plan AS (SELECT pl.file_path, pl.canonical, k AS key, CASE WHEN s.body IS NULL THEN 'create' ELSE 'version' END AS mutation, coalesce(s.body <> pl.body, false) AS stale FROM pl LEFT JOIN sym s ON s.key = k),
 rt AS (SELECT key FROM sym WHERE file_path IN (SELECT file_path FROM ch WHERE NOT added) AND key NOT IN (SELECT key FROM plan))"""
_WORD = "CASE kind WHEN 'reads_from' THEN 'reads' ELSE 'writes' END"
_SCHEMA = f"""t AS (SELECT identifier AS entity, {dv.bucket_sql('identifier', 7)} AS b FROM n WHERE kind = 'db_entity'),
 own AS (SELECT entity, bool_or(destructive) AS destructive, string_agg(DISTINCT txt, '; ' ORDER BY txt) AS changes FROM (SELECT entity, b IN (0, 1, 2) AS destructive, CASE b WHEN 0 THEN entity || '.note dropped' WHEN 1 THEN entity || '.amount type changed'
 WHEN 2 THEN entity || '.note became NOT NULL' WHEN 3 THEN entity || '.extra added' END AS txt FROM t WHERE b <= 3) GROUP BY entity)"""

ORACLE = {
    "changed_entities": f"{_BASE} SELECT * FROM en",
    "change_signals": f"{_BASE} SELECT change, count(*) AS symbols, count(*) FILTER (change IN ('formatting_only','rename','refactor_likely')) AS silent FROM en GROUP BY change",
    "review_findings": f"{_BASE}, {_FOUND} SELECT *, CASE intent_kind {_ACTION} ELSE 'Verify the product intent remains accurate for this behavior change.' END AS action FROM df",
    "indirect_findings": f"{_BASE}, {_FOUND}, {_INDIRECT}",
    "review_gate": f"""{_BASE}, {_FOUND} SELECT coalesce(bool_or(severity = 'high'), false) AS high, coalesce(bool_or(severity IN ('high','medium')), false) AS medium, coalesce(bool_or(intent_kind = 'invariant'), false) AS invariant,
 (SELECT coalesce(bool_or(destructive), false) FROM ({_CHANGE['api_changes']})) AS destructive FROM df""",
    "access_signals": f"""{_ACCESS}, b AS (SELECT symbol, kind, string_agg(target, ', ' ORDER BY target) AS t FROM x GROUP BY 1, 2), a AS (SELECT symbol, kind, string_agg(target, ', ' ORDER BY target) AS t FROM y GROUP BY 1, 2)
 SELECT symbol, 'database ' || {_WORD} || ' changed: ' || coalesce(b.t, 'none') || ' -> ' || coalesce(a.t, 'none') AS signal FROM b FULL JOIN a USING (symbol, kind) WHERE a.t IS DISTINCT FROM b.t""",
    "api_findings": f"""{dv.BASE}, ac AS ({_CHANGE['api_changes']}), own AS (SELECT method || ' ' || path AS entity, bool_or(destructive) AS destructive, string_agg(DISTINCT CASE kind WHEN 'contract_modified' THEN 'changed' ELSE kind END || ' ' || method || ' ' || path
 || CASE WHEN details <> '' THEN ' (' || details || ')' ELSE '' END, '; ') AS changes FROM ac GROUP BY 1),
 tou AS (SELECT DISTINCT entity, src AS symbol FROM own JOIN gcl ON {dv.bucket_sql('src', 7)} = {dv.bucket_sql('entity', 7)}) {_AROUND}""",
    "schema_findings": f"{dv.BASE}, {_SCHEMA}, tou AS (SELECT DISTINCT entity, src AS symbol FROM own JOIN gcl ON {dv.bucket_sql('src', 11)} = {dv.bucket_sql('entity', 11)}) {_AROUND}",
    "index_plan": f"{_NAMED} SELECT * FROM plan",
    "index_retired": f"{_NAMED} SELECT key FROM rt",
    "index_summary": f"""{_NAMED} SELECT count(*) AS symbols, count(*) FILTER (mutation = 'create') AS created, count(*) FILTER (mutation = 'version') AS versioned, count(*) FILTER (stale) AS stale, count(*) - count(DISTINCT key) AS doubled,
 (SELECT count(*) FROM rt) AS retired, (SELECT count(*) FROM ch WHERE NOT deleted) AS files FROM plan""",
    "collision_keys": f"""{dv.BASE}, c AS (SELECT key AS stable_key, 'symbol:' || language || ':' || lower(name[1:6]) || ':' || upper(kind[1]) || kind[2:] AS base FROM sym), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY stable_key) AS k FROM c)
 SELECT stable_key, base || CASE WHEN k = 1 THEN '' ELSE '#' || k END AS key FROM r""",
    "entity_facts": f"{_ACCESS} SELECT DISTINCT target, 'create' AS act FROM y WHERE target NOT IN (SELECT target FROM x) UNION ALL SELECT DISTINCT target, 'retire' FROM x WHERE target NOT IN (SELECT target FROM y)",
    "call_nodes": """WITH x AS (SELECT DISTINCT trim(stable_key) AS key FROM external_calls WHERE recorded_at < TIMESTAMP '2025-01-01'), y AS (SELECT DISTINCT trim(stable_key) AS key FROM external_calls WHERE recorded_at >= TIMESTAMP '2025-01-01')
 SELECT key, 'create' AS act FROM y WHERE key NOT IN (SELECT key FROM x) UNION ALL SELECT key, 'retire' FROM x WHERE key NOT IN (SELECT key FROM y)""",
    "cross_file_moves": f"{_BASE} SELECT en.stable_key, sym.file_path AS was, en.file_path, en.new FROM en JOIN sym ON sym.key = en.stable_key WHERE change = 'rename' AND en.file_path <> sym.file_path",
}
