"""Queries on links, records, checks, samples and what surrounds a symbol, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.model import STRUCTURAL
from lodestone.operators import graph as g, repair, rows as rw, scoring, store
from lodestone.operators.graph import both_ways
from lodestone.plans import derived as dv
from lodestone.plans.artifact_queries import changed_symbol_links, issue_depths
from lodestone.plans.repair_queries import _occurrences
from lodestone.plans.review_queries import _columns
from lodestone.plans.text_queries import intent_clusters, overlap_pairs
from lodestone.session import read
from lodestone.sources.graph import load


def reference_kinds(spark: SparkSession, d: str) -> DataFrame:
    """References of documents by kind, and how many may name the kind of the document itself."""
    docs = read(spark, d, "documents").select("doc_id", "artifact_kind", F.inline(text.references(F.col("text"))))
    return docs.groupBy("kind", "artifact_kind").agg(F.count(F.lit(1)).alias("refs"), F.count_if(rw.may_match(F.col("kind"), F.col("artifact_kind"))).alias("fit"))


def controlled_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls inside derived regions of each symbol."""
    e = load(spark, d).edges.filter("kind = 'calls' and status = 'active'").select("src", "dst").distinct()
    per = e.groupBy("src").agg(F.collect_list(F.struct(F.col("dst").alias("name"), dv.bucket(F.col("dst"), 100).alias("line"))).alias("calls"))
    regions = F.array(F.struct(F.lit(0).alias("lo"), F.lit(30).alias("hi")), F.struct(F.lit(60).alias("lo"), F.lit(80).alias("hi")))
    return per.select("src", F.array_join(rw.controlled(F.col("calls"), regions), ",").alias("controlled"))


def _pinned(spark: SparkSession, d: str) -> DataFrame:
    """(document, key): anchors of active documents put on current symbols."""
    graph = load(spark, d)
    code = graph.nodes.filter("kind = 'code_symbol'").groupBy(dv.bucket(F.col("stable_key"), 29).alias("b")).agg(F.min("stable_key").alias("key"))
    docs = graph.nodes.filter("anchors is not null") if "anchors" in graph.nodes.columns else read(spark, d, "nodes").filter("anchors is not null")
    links = repair.document_links(docs.withColumn("stable_key", F.trim("stable_key")))
    return links.select("document", dv.bucket(F.col("symbol"), 29).alias("b")).distinct().join(code, "b").select("document", "key").distinct()


def explanation_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an anchor within two structural edges of an event."""
    graph = load(spark, d)
    events = graph.nodes.filter("kind = 'event'").select(F.col("stable_key").alias("key"))
    edges = graph.edges.filter((F.col("status") == "active") & F.col("kind").isin(*STRUCTURAL))
    near = g.distances(edges, events, 2)
    return _pinned(spark, d).join(near, "key").groupBy("document").agg(F.min("depth").alias("depth"))


def mapped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that an active claim maps and whose anchor lies on a mapped symbol."""
    c = dv.claims(load(spark, d)).filter("status = 'active' and kind <> 'covered_by'").select(F.col("src").alias("key"), "dst").distinct()
    return _pinned(spark, d).join(c, "key").groupBy("document").agg(F.countDistinct("dst").alias("intents"))


def symbol_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The first six symbols next to each symbol over active calls."""
    e = load(spark, d).edges.filter("kind = 'calls' and status = 'active'").select("src", "dst")
    around = both_ways(e).distinct().toDF("symbol", "other")
    order = Window.partitionBy("symbol").orderBy("other")
    return around.withColumn("rank", F.row_number().over(order)).filter("rank <= 6")


def test_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first four tests next to each symbol by calls or coverage."""
    graph = dv.grafted(load(spark, d))
    around = both_ways(graph.edges.filter("status = 'active' and kind in ('calls', 'covered_by')").select("src", "dst")).distinct().toDF("symbol", "stable_key")
    tests = graph.nodes.filter("is_test").select("stable_key", "identifier")
    near = around.join(tests, "stable_key").select("symbol", "identifier").distinct()
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("identifier"))).filter("rank <= 4")


def endpoint_intents(spark: SparkSession, d: str) -> DataFrame:
    """Intents behind the handlers of endpoints, and behind what these call."""
    graph = load(spark, d)
    claims = dv.claims(graph).filter("status = 'active' and kind in ('implements', 'enforces', 'satisfies')").select(F.col("src").alias("symbol"), F.col("dst").alias("intent")).distinct()
    at = graph.edges.filter("kind = 'exposes' and status = 'active'").select(F.col("dst").alias("endpoint"), F.col("src").alias("symbol")).distinct()
    called = at.join(g.callers(graph).select(F.col("caller").alias("symbol"), "callee"), "symbol").select("endpoint", F.col("callee").alias("symbol"))
    return at.unionByName(called).distinct().join(claims, "symbol").groupBy("endpoint").agg(F.array_join(F.array_sort(F.collect_set("intent")), ",").alias("intents"))


def merge_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Intents that should merge: the least of each overlapping pair stays."""
    p = overlap_pairs(spark, d)
    return p.groupBy("b").agg(F.min("a").alias("kept"), F.count(F.lit(1)).alias("rivals")).withColumnRenamed("b", "merged")


def cluster_merges(spark: SparkSession, d: str) -> DataFrame:
    """Merges inside clusters of intents of which a hash accepted some."""
    c = intent_clusters(spark, d).select(F.col("stable_key").alias("member"), "cluster")
    return rw.merges(c, c.filter(dv.bucket(F.col("member"), 3) < 2).select("member"))


def unique_entities(spark: SparkSession, d: str) -> DataFrame:
    """The table of symbols that touch exactly one."""
    e = load(spark, d).edges.filter("kind in ('reads_from', 'writes_to', 'defines_schema') and status = 'active'")
    return e.groupBy("src").agg(rw.only(F.col("dst")).alias("entity"))


def callee_names(spark: SparkSession, d: str) -> DataFrame:
    """Called names that one callee of a caller alone has."""
    graph = load(spark, d)
    names = graph.nodes.filter("kind = 'code_symbol'").select(F.col("stable_key").alias("callee"), F.substring("name", 1, 5).alias("name"))
    return rw.unique_callees(g.callers(graph).select("caller", "callee"), names)


def effect_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first eight effects of each symbol as text."""
    e = load(spark, d).edges.filter("status = 'active' and kind in ('reads_from', 'writes_to', 'calls_external')")
    return rw.effects_of(e, "src", F.concat_ws(" ", "kind", "dst"))


def link_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the signals of the links over grafted claims say, and how often."""
    found = scoring.link_candidates(dv.grafted(load(spark, d)), 3000)
    return found.groupBy(rw.told(["lexical", "structural", "test", "data", "artifact"]).alias("says")).agg(F.count(F.lit(1)).alias("links"))


def code_links(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each intent, as a set."""
    c = dv.claims(load(spark, d)).filter("status <> 'rejected' and kind <> 'covered_by'")
    return c.groupBy(F.col("dst").alias("intent")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("symbols"))


def failed_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Derived file changes when every fifth file cannot be read."""
    sym = dv.symbols(load(spark, d))
    changes = dv.file_changes(sym, dv.later(sym))
    bad = changes.filter("new_path is not null").select(F.col("new_path").alias("path")).filter(dv.bucket(F.col("path"), 5) == 0)
    return rw.after_failures(changes, bad)


def changed_scope(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of changed files whose body or signature is not what it was."""
    sym = dv.symbols(load(spark, d))
    after = dv.later(sym)
    files = dv.file_changes(sym, after).filter("new_path is not null").select(F.col("new_path").alias("file_path"))
    same = sym.select("canonical", "body", F.coalesce("signature", F.lit("-")).alias("sig"))
    rows = after.join(files, "file_path", "left_semi").withColumn("sig", F.coalesce("signature", F.lit("-")))
    return rows.join(same, ["canonical", "body", "sig"], "left_anti").select("key", "canonical", "file_path")


def graded_checks(spark: SparkSession, d: str) -> DataFrame:
    """Derived checks on the kinds of nodes, passed and failed by kind of check."""
    n = load(spark, d).nodes.select(F.col("kind").alias("case"), F.col("identifier").alias("value"))
    b = dv.bucket(F.col("value"), 40)
    some = n.distinct().filter(b < 3)
    kind = F.when(b == 0, "contains").when(b == 1, "absent").otherwise("at_least")
    checks = some.select("case", kind.alias("kind"), F.when(b == 0, F.concat("value", F.when(F.length("value") % 2 == 0, "").otherwise("?"))).otherwise(F.col("value")).alias("value"), F.lit(100).alias("number"))
    return rw.evaluated(checks, n).groupBy("kind").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("passed")).alias("passed"))


def second_review(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the documents of each source by hash, without those that have a rating."""
    docs = read(spark, d, "documents").select("source", "doc_id")
    rated = read(spark, d, "reading_labels").select("doc_id", F.lit(True).alias("rated")).distinct()
    return rw.review_sample(docs.join(rated, "doc_id", "left"), "source", "doc_id", F.col("rated"), "7:")


def frozen_orders(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first ten of each source are still its first ten when the documents grow."""
    docs = read(spark, d, "documents").select(F.col("source").alias("group"), F.col("doc_id").cast("string").alias("item"))
    order = Window.partitionBy("group").orderBy(F.sha2("item", 256))
    first = docs.filter(dv.bucket(F.col("item"), 50) != 0).withColumn("place", F.row_number().over(order)).filter("place <= 10")
    return rw.extended(first, docs.withColumn("place", F.row_number().over(order)).filter("place <= 10"))


def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """Derived tables as text."""
    return rw.rendered_columns(_columns(load(spark, d))[0])


def claim_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose fingerprint is the one their ends and kind make, by kind."""
    e = read(spark, d, "edges").select("edge_id", "src", "dst", "kind", "fingerprint").distinct()
    made = F.concat(F.trim("src"), F.lit(":"), F.replace(F.initcap(F.replace(F.col("kind"), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), F.lit(":"), F.trim("dst"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.lower(made) == F.lower("fingerprint")).alias("same"))


def index_heads(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots' references as commits."""
    r = read(spark, d, "index_snapshots").select("commit_seq", F.concat(F.when(F.col("commit_seq") % 2 == 0, "worktree@").otherwise(""), F.upper("commit_oid")).alias("ref"))
    return r.select("commit_seq", rw.head_reference(F.col("ref")).alias("h")).select("commit_seq", "h.commit", "h.worktree")


def unanalysed_scope(spark: SparkSession, d: str) -> DataFrame:
    """Issues in scope that no succeeded run has analysed, by depth."""
    runs = read(spark, d, "enrich_runs").filter("run_status = 'succeeded'").select("run_id")
    done = read(spark, d, "analyzed_inputs").filter("kind = 'issue'").join(runs, "run_id", "left_semi").select(F.col("external_id").alias("key")).distinct()
    return issue_depths(spark, d).join(done, "key", "left_anti").groupBy("depth").agg(F.count(F.lit(1)).alias("issues"))


def symbol_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty commits that touched each symbol."""
    e = read(spark, d, "edges").filter("valid_to is null").select("valid_from", F.explode("evidence.commit").alias("commit")).filter("commit is not null").groupBy("commit").agg(F.max("valid_from").alias("seq"))
    j = changed_symbol_links(spark, d).join(e, "commit")
    order = Window.partitionBy("stable_key").orderBy(F.col("seq").desc(), "commit")
    return j.withColumn("rank", F.row_number().over(order)).filter("rank <= 20").select("stable_key", "commit", "rank")


def unrecorded_points(spark: SparkSession, d: str) -> DataFrame:
    """Decision points without a record, by symbol: what a sync would dismiss."""
    now = _occurrences(spark, d)
    kept = now.filter(dv.bucket(F.col("symbol"), 3) == 0).select("symbol", "fingerprint", "line")
    return now.join(kept, ["symbol", "fingerprint", "line"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("points"))


def merged_links(spark: SparkSession, d: str) -> DataFrame:
    """Comment links of the first half with those of the second in place of equal ones; some targets are null."""
    c = read(spark, d, "jira_comments").select(F.col("comment_id").alias("src"), F.when(dv.bucket(F.col("comment_id"), 5) > 0, F.col("issue_key")).alias("target"), F.lit("comments_on").alias("kind"), F.date_format("fetched_at", "yyyy-MM-dd").alias("locator"), "fetched_at")
    half = F.lit("2025-01-01").cast("timestamp_ntz")
    cut = lambda df: df.select("src", "target", "kind", "locator").distinct()
    out = rw.upsert_links(cut(c.filter(F.col("fetched_at") < half)), cut(c.filter(F.col("fetched_at") >= half)))
    return out.groupBy(F.substring("locator", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("links"), F.count("target").alias("targets"))


def plain_notes(spark: SparkSession, d: str) -> DataFrame:
    """Comments that are no notes of the system, per issue project: authors and notes."""
    c = read(spark, d, "jira_comments").select("comment_id", "issue_key", "display_name", F.col("display_name").rlike(r"(?i)bot|sync|service|system").alias("machine")).distinct()
    return c.filter(~F.coalesce("machine", F.lit(False))).groupBy(F.split("issue_key", "-")[0].alias("project")).agg(F.countDistinct("comment_id").alias("notes"), F.countDistinct("display_name").alias("authors"))


def candidate_sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents that issue keys may be taken from: of git, merge requests, and review comments."""
    docs = read(spark, d, "documents").select("doc_id", "source", "artifact_kind")
    git = F.split("source", ":")[0] == "git"
    why = F.when(git, "git").when(F.col("artifact_kind") == "merge_request", "merge_request").when(F.col("artifact_kind") == "review_comment", "comment")
    return docs.groupBy(why.alias("why"), "artifact_kind").agg(F.count(F.lit(1)).alias("docs")).filter("why is not null")


def knowledge_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the accepted candidate each came from, where there is one, by kind."""
    docs = read(spark, d, "documents").filter("artifact_kind in ('requirement', 'decision')").select("external_id", "artifact_kind").distinct()
    accepted = docs.filter(dv.bucket(F.col("external_id"), 4) == 0).select("external_id", F.concat_ws(":", F.lit("knowledge"), "artifact_kind", "external_id").alias("candidate"))
    return docs.join(accepted, "external_id", "left").groupBy("artifact_kind").agg(F.count(F.lit(1)).alias("documents"), F.count("candidate").alias("from_candidates"))


QUERIES = {
    f.__name__: f
    for f in (
        reference_kinds, controlled_calls, explanation_documents, mapped_documents, symbol_neighbors, test_evidence, endpoint_intents, merge_proposals, cluster_merges, unique_entities, callee_names, effect_texts, link_texts, code_links,
        failed_analysis, changed_scope, graded_checks, second_review, frozen_orders, table_texts, claim_fingerprints, index_heads, unanalysed_scope, symbol_history, unrecorded_points, merged_links, plain_notes, candidate_sources,
        knowledge_provenance,
    )
}

from lodestone.plans.artifact_queries import ORACLE as _ART  # noqa: E402
from lodestone.plans.graph_queries import _CALLS, _T, GRAPH, _bfs  # noqa: E402
from lodestone.plans.repair_queries import _DL, _OCC, ORACLE as _REPAIR  # noqa: E402
from lodestone.plans.review_queries import _NAMED  # noqa: E402
from lodestone.plans.text_queries import ORACLE as _TEXT, _refs  # noqa: E402

_PIN = f"""{_DL}, pk AS (SELECT {dv.bucket_sql('stable_key', 29)} AS b, min(stable_key) AS key FROM n WHERE kind = 'code_symbol' GROUP BY 1), pin AS (SELECT DISTINCT document, key FROM (SELECT document, {dv.bucket_sql('symbol', 29)} AS b FROM dl) JOIN pk USING (b))"""
_SCORED = _REPAIR["grafted_scores"].rsplit(" SELECT relation,", 1)[0]
_SAY = ", ".join(f"CASE WHEN {s} > 0 THEN '{t} (' || {s} || ')' END" for s, t in rw.SIGNALS.items())

ORACLE = {
    "reference_kinds": f"""SELECT kind, artifact_kind, count(*) AS refs, count(*) FILTER (CASE kind WHEN 'merge_request_number' THEN artifact_kind IN ('merge_request','pull_request') WHEN 'url' THEN artifact_kind IN ('issue','merge_request','pull_request','commit') ELSE artifact_kind = 'issue' END) AS fit
 FROM ({_refs('documents', 'doc_id', 'text')}) JOIN documents USING (doc_id) GROUP BY 1, 2""",
    "controlled_calls": f"""WITH {GRAPH}, {_CALLS}, c AS (SELECT a, b, {dv.bucket_sql('b', 100)} AS line FROM calls) SELECT a AS src, coalesce(string_agg(DISTINCT b, ',' ORDER BY b) FILTER (line <= 30 OR line BETWEEN 60 AND 80), '') AS controlled FROM c GROUP BY a""",
    "explanation_documents": f"WITH {GRAPH} {_bfs(chr(107) + 'ind = ' + chr(39) + 'event' + chr(39), f'status = {chr(39)}active{chr(39)} AND kind IN {_T}', 2)}, {_PIN} SELECT document, min(depth) AS depth FROM pin JOIN dist USING (key) GROUP BY document",
    "mapped_documents": f"{dv.BASE}, {_PIN} SELECT document, count(DISTINCT dst) AS intents FROM pin JOIN gcl ON gcl.src = pin.key WHERE gcl.status = 'active' AND gcl.kind <> 'covered_by' GROUP BY document",
    "symbol_neighbors": f"""WITH {GRAPH}, {_CALLS}, ar AS (SELECT a AS symbol, b AS other FROM calls UNION SELECT b, a FROM calls) SELECT symbol, other, row_number() OVER (PARTITION BY symbol ORDER BY other)::INT AS rank FROM ar QUALIFY rank <= 6""",
    "test_evidence": f"""{dv.BASE}, x AS (SELECT src, dst FROM e WHERE status = 'active' AND kind IN ('calls','covered_by') UNION SELECT src, dst FROM gcl WHERE status = 'active' AND kind = 'covered_by'), ar AS (SELECT src AS symbol, dst AS o FROM x UNION SELECT dst, src FROM x WHERE src <> dst),
 t AS (SELECT DISTINCT symbol, identifier FROM ar JOIN n ON n.stable_key = o AND n.is_test) SELECT symbol, identifier, row_number() OVER (PARTITION BY symbol ORDER BY identifier)::INT AS rank FROM t QUALIFY rank <= 4""",
    "endpoint_intents": f"""{dv.BASE}, {_CALLS}, x AS (SELECT DISTINCT dst AS endpoint, src AS symbol FROM e WHERE kind = 'exposes' AND status = 'active'), y AS (SELECT * FROM x UNION SELECT endpoint, b FROM x JOIN calls ON a = symbol)
 SELECT endpoint, string_agg(DISTINCT dst, ',' ORDER BY dst) AS intents FROM y JOIN gcl ON gcl.src = symbol WHERE gcl.status = 'active' AND gcl.kind IN ('implements','enforces','satisfies') GROUP BY endpoint""",
    "merge_proposals": f"SELECT b AS merged, min(a) AS kept, count(*) AS rivals FROM ({_TEXT['overlap_pairs']}) GROUP BY b",
    "cluster_merges": f"""WITH c AS (SELECT stable_key AS member, cluster FROM ({_TEXT['intent_clusters']})), k AS (SELECT *, min(member) OVER (PARTITION BY cluster) AS kept, count(*) OVER (PARTITION BY cluster) AS n FROM c WHERE {dv.bucket_sql('member', 3)} < 2)
 SELECT cluster, kept, member AS merged FROM k WHERE n >= 2 AND member <> kept""",
    "unique_entities": f"WITH {GRAPH} SELECT src, CASE WHEN count(DISTINCT dst) = 1 THEN min(dst) END AS entity FROM e WHERE kind IN ('reads_from','writes_to','defines_schema') AND status = 'active' GROUP BY src",
    "callee_names": f"WITH {GRAPH}, {_CALLS} SELECT a AS caller, name[1:5] AS name, min(b) AS callee FROM calls JOIN n ON n.stable_key = b AND n.kind = 'code_symbol' GROUP BY a, name[1:5] HAVING count(DISTINCT b) = 1",
    "effect_texts": f"""WITH {GRAPH}, x AS (SELECT DISTINCT src, kind || ' ' || dst AS t FROM e WHERE status = 'active' AND kind IN ('reads_from','writes_to','calls_external')), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t) AS k FROM x)
 SELECT src, string_agg(t, '; ' ORDER BY t) AS effects FROM r WHERE k <= 8 GROUP BY src""",
    "link_texts": f"{_SCORED} SELECT array_to_string(list_filter([{_SAY}], lambda x: x IS NOT NULL), ', ') AS says, count(*) AS links FROM sc WHERE lexical + structural + test + data >= 3000 GROUP BY 1",
    "code_links": f"{dv.BASE} SELECT dst AS intent, string_agg(DISTINCT src, ',' ORDER BY src) AS symbols FROM gcl WHERE status <> 'rejected' AND kind <> 'covered_by' GROUP BY dst",
    "failed_analysis": f"""{_NAMED}, b AS (SELECT *, NOT deleted AND {dv.bucket_sql('file_path', 5)} = 0 AS bad FROM ch) SELECT CASE WHEN bad OR deleted THEN 'deleted' WHEN added THEN 'added' ELSE 'modified' END AS op, CASE WHEN NOT added THEN file_path END AS old_path, CASE WHEN NOT deleted AND NOT bad THEN file_path END AS new_path
 FROM b WHERE NOT (bad AND added)""",
    "changed_scope": f"""{_NAMED} SELECT key, canonical, file_path FROM nxt WHERE file_path IN (SELECT file_path FROM ch WHERE NOT deleted) AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.canonical = nxt.canonical AND s.body = nxt.body AND coalesce(s.signature, '-') = coalesce(nxt.signature, '-'))""",
    "graded_checks": f"""WITH {GRAPH}, v AS (SELECT DISTINCT kind AS c, identifier AS value, {dv.bucket_sql('identifier', 40)} AS b FROM n), s AS (SELECT c, count(*) AS k FROM v GROUP BY c)
 SELECT CASE b WHEN 0 THEN 'contains' WHEN 1 THEN 'absent' ELSE 'at_least' END AS kind, count(*) AS checks, count(*) FILTER (CASE b WHEN 0 THEN length(value) % 2 = 0 WHEN 1 THEN false ELSE k >= 100 END) AS passed FROM v JOIN s USING (c) WHERE b < 3 GROUP BY 1""",
    "second_review": """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id))::INT AS place, count(*) OVER (PARTITION BY source) AS k FROM documents)
 SELECT source, doc_id, place FROM r WHERE place <= ceil(k / 5.0) AND doc_id NOT IN (SELECT doc_id FROM reading_labels)""",
    "frozen_orders": f"""WITH d AS (SELECT source, doc_id::VARCHAR AS item FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(item)) AS place FROM d WHERE {dv.bucket_sql('item', 50)} <> 0 QUALIFY place <= 10),
 b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(item)) AS place FROM d QUALIFY place <= 10) SELECT a.source AS "group", bool_and(a.item IS NOT DISTINCT FROM b.item) AS kept, count(*) AS places FROM a LEFT JOIN b USING (source, place) GROUP BY 1""",
    "table_texts": f"WITH {GRAPH} SELECT identifier AS entity, identifier || ' (amount int, id bigint PK NOT NULL, note text)' AS text FROM n WHERE kind = 'db_entity'",
    "claim_fingerprints": """SELECT kind, count(*) AS claims, count(*) FILTER (lower(trim(src) || ':' || replace(kind, '_', '') || ':' || trim(dst)) = lower(fingerprint)) AS same FROM (SELECT DISTINCT edge_id, src, dst, kind, fingerprint FROM edges) GROUP BY kind""",
    "index_heads": "SELECT commit_seq, CASE WHEN regexp_full_match(lower(commit_oid), '[0-9a-f]{4,64}') THEN lower(commit_oid) END AS commit, CASE WHEN regexp_full_match(lower(commit_oid), '[0-9a-f]{4,64}') THEN commit_seq % 2 = 0 END AS worktree FROM index_snapshots",
    "unanalysed_scope": f"""SELECT depth, count(*) AS issues FROM ({_ART['issue_depths']}) WHERE key NOT IN (SELECT external_id FROM analyzed_inputs JOIN enrich_runs USING (run_id) WHERE run_status = 'succeeded' AND kind = 'issue') GROUP BY depth""",
    "symbol_history": f"""WITH c AS (SELECT x.commit AS commit, max(valid_from) AS seq FROM (SELECT valid_from, unnest(evidence) AS x FROM edges WHERE valid_to IS NULL) WHERE x.commit IS NOT NULL GROUP BY 1)
 SELECT stable_key, commit, row_number() OVER (PARTITION BY stable_key ORDER BY seq DESC, commit)::INT AS rank FROM ({_ART['changed_symbol_links']}) JOIN c USING (commit) QUALIFY rank <= 20""",
    "unrecorded_points": f"WITH {_DL}, {_OCC} SELECT symbol, count(*) AS points FROM oc WHERE {dv.bucket_sql('symbol', 3)} <> 0 GROUP BY symbol",
    "merged_links": f"""WITH c AS (SELECT DISTINCT comment_id AS src, CASE WHEN {dv.bucket_sql('comment_id', 5)} > 0 THEN issue_key END AS target, strftime(fetched_at, '%Y-%m-%d') AS locator, fetched_at >= TIMESTAMP '2025-01-01' AS late FROM jira_comments),
 f AS (SELECT src, target, max(locator) AS locator FROM c WHERE late GROUP BY 1, 2), o AS (SELECT DISTINCT src, target, locator FROM c WHERE NOT late AND NOT EXISTS (SELECT 1 FROM f WHERE f.src = c.src AND f.target IS NOT DISTINCT FROM c.target))
 SELECT locator[1:7] AS month, count(*) AS links, count(target) AS targets FROM (SELECT * FROM o UNION ALL SELECT * FROM f) GROUP BY 1""",
    "plain_notes": """SELECT string_split(issue_key, '-')[1] AS project, count(DISTINCT comment_id) AS notes, count(DISTINCT display_name) AS authors FROM jira_comments WHERE NOT coalesce(regexp_matches(display_name, '(?i)bot|sync|service|system'), false) GROUP BY 1""",
    "candidate_sources": """SELECT CASE WHEN starts_with(source, 'git:') THEN 'git' WHEN artifact_kind = 'merge_request' THEN 'merge_request' WHEN artifact_kind = 'review_comment' THEN 'comment' END AS why, artifact_kind, count(*) AS docs FROM documents
 WHERE starts_with(source, 'git:') OR artifact_kind IN ('merge_request','review_comment') GROUP BY 1, 2""",
    "knowledge_provenance": f"SELECT artifact_kind, count(*) AS documents, count(*) FILTER ({dv.bucket_sql('external_id', 4)} = 0) AS from_candidates FROM (SELECT DISTINCT external_id, artifact_kind FROM documents WHERE artifact_kind IN ('requirement','decision')) GROUP BY 1",
}
