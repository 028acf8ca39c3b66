"""Queries on drift, repairs, verdicts as state, anchors, sources and connectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ddl, text
from lodestone.model import INTENTS, LIVE_STATUS, state
from lodestone.operators import anchors as an, repair, scoring, snapshots as sn, store, status as st
from lodestone.operators.artifacts import issue_links
from lodestone.operators.orphans import clean_key
from lodestone.plans import derived as dv
from lodestone.plans.change_queries import freshness
from lodestone.plans import graph_queries
from lodestone.plans.graph_queries import stale_claims, unmapped_intents
from lodestone.session import read
from lodestone.sources.graph import Graph, load

HALF = "2025-01-01"


def _half():
    return F.lit(HALF).cast("timestamp_ntz")


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Current and past symbols: (name, key, shape), by their names without the ending of the table."""
    bare = F.regexp_replace("identifier", r"_[a-z0-9]{3}$", "")
    code = lambda n, *more: n.filter("kind = 'code_symbol'").select(bare.alias("name"), F.col("stable_key").alias("key"), dv.bucket(F.col("content_hash"), 400).cast("string").alias("shape")).distinct()
    nodes = read(spark, d, "nodes").withColumn("stable_key", clean_key(F.col("stable_key")))
    return code(load(spark, d).nodes), code(nodes.filter("retired_commit is not null"))


def _verbs(spark: SparkSession, d: str) -> DataFrame:
    """Links of the documents, their symbols cut as those of :func:`_names`."""
    return repair.document_links(load_all(spark, d)).withColumn("symbol", F.regexp_replace("symbol", r"_[^.]*$", ""))


def document_drift(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of documents whose symbol is no current one, by what may be done about them."""
    current, past = _names(spark, d)
    return repair.drift(_verbs(spark, d), current, past)


def drift_suggestions(spark: SparkSession, d: str) -> DataFrame:
    current, _ = _names(spark, d)
    return repair.suggested(document_drift(spark, d), current)


def repaired_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents and symbols after the sure repairs."""
    return repair.applied(_verbs(spark, d).select("document", "symbol").distinct(), document_drift(spark, d))


def stale_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected claims that documents still hold."""
    return repair.rejected_stale(dv.grafted(load(spark, d)))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).edges.filter("claim_class = 'inference'")
    return e.select("fingerprint", "src", "dst", "kind", "claim_class", "source_kind", "confidence_bp", "status", "producer", "valid_from", "stale_reason").dropDuplicates(["fingerprint"])


def recorded_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Inferences after a third of them was accepted and a third rejected; contradictions count nothing."""
    c = _claims(spark, d)
    b = dv.bucket(F.col("fingerprint"), 3)
    said = c.filter(b < 2).select("fingerprint", F.when(b == 0, "accept").otherwise("reject").alias("verdict"))
    both = c.filter(dv.bucket(F.col("fingerprint"), 10) == 5).select("fingerprint", F.explode(F.array(F.lit("accept"), F.lit("reject"))).alias("verdict"))
    out = repair.recorded(c.drop("stale_reason"), said.union(both), 5000)
    return out.groupBy("claim_class", "source_kind", "status", "producer").agg(F.count(F.lit(1)).alias("claims"), F.max("valid_from").alias("newest"))


def reactivated_claims(spark: SparkSession, d: str) -> DataFrame:
    """Stale claims of which every second is confirmed."""
    e = load(spark, d).edges.select("fingerprint", "status", "stale_reason").distinct()
    good = e.filter(dv.bucket(F.col("fingerprint"), 2) == 0).select("fingerprint", F.lit("checked").alias("note"))
    return repair.reactivated(e, good).filter("annotation is not null").select("fingerprint", "status", "stale_reason", "annotation")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("artifact_kind in ('requirement', 'decision')")
    return docs.select(F.col("external_id").alias("id"), F.concat_ws(":", F.lit("knowledge"), "artifact_kind", "external_id").alias("fingerprint"), F.lit("pending").alias("state")).distinct()


def candidate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge candidates by state after some were decided."""
    q = _queue(spark, d)
    b = dv.bucket(F.col("id"), 4)
    return repair.decided(q, q.filter(b < 2).select("id", F.when(b == 0, "accepted").otherwise("rejected").alias("decision"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def offered_candidates(spark: SparkSession, d: str) -> DataFrame:
    """A queue after all candidates are offered again: the ones in it or decided stay out."""
    q = _queue(spark, d)
    b = dv.bucket(F.col("id"), 4)
    return repair.offered(q.filter(b == 0), q, q.filter(b == 1)).select("id")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays of issues, their links and the ledger when a tenth of the issues goes."""
    issues = read(spark, d, "jira_issues").select(F.col("issue_key").alias("id")).distinct()
    links = issue_links(read(spark, d, "jira_issues")).select(F.col("a").alias("src"), F.col("b").alias("target"))
    ledger = read(spark, d, "analyzed_inputs").filter("kind = 'issue'").select("ledger_id", "external_id").distinct()
    a, b, c = repair.cascade(issues, links, ledger, issues.filter(dv.bucket(F.col("id"), 10) == 0))
    one = lambda df, n: df.select(F.lit(n).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return one(a, "issues").union(one(b, "links")).union(one(c, "ledger"))


def first_free_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first unused number of each stem of issue keys."""
    return repair.first_free(read(spark, d, "jira_issues").select("issue_key"), "issue_key")


def claim_batches(spark: SparkSession, d: str) -> DataFrame:
    """Stale claims in batches of at most ten rows or 1000 bytes, per sixteenth of the claims."""
    c = load(spark, d).edges.filter("status = 'stale'").select("fingerprint").distinct().withColumn("part", dv.bucket(F.col("fingerprint"), 16))
    out = repair.batches(c, "part", [F.col("fingerprint")], F.octet_length("fingerprint"), 10, 1000)
    return out.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("fingerprint")).cast("long").alias("bytes"), F.min("fingerprint").alias("first"))


def document_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each anchor."""
    return an.documents_of(load_all(spark, d))


def load_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nodes").withColumn("stable_key", clean_key(F.col("stable_key")))


def confirmed_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of active intents whose symbol has that many occurrences of the fingerprint now."""
    points = _occurrences(spark, d)
    intents = load_all(spark, d).filter(F.col("kind").isin(*INTENTS) & state(F.col("status")).isin(*LIVE_STATUS))
    return an.confirmed(intents, points)


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Derived decision points: as many of an anchor's fingerprint as a hash says, up to two."""
    a = repair.document_links(load_all(spark, d)).select("symbol", "fingerprint").distinct()
    return a.withColumn("times", dv.bucket(F.concat("symbol", "fingerprint"), 3).cast("int")).filter("times > 0").select("symbol", "fingerprint", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("line"))


def new_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision points of now beyond what stood before and what documents explain."""
    now = _occurrences(spark, d)
    before = now.filter((F.col("line") == 1) & (dv.bucket(F.col("symbol"), 2) == 0))
    return an.new_points(before, now, confirmed_anchors(spark, d))


def _tree(spark: SparkSession, d: str, at: int) -> DataFrame:
    return sn.tree_at(read(spark, d, "source_files").select("path", "content_hash", "commit_seq"), at)


def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files there at one commit."""
    return _tree(spark, d, dv.T1)


def batch_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Texts of wanted paths at two commits; a missing one is null."""
    files = read(spark, d, "source_files").select("path", "commit_seq", F.length("text").alias("chars")).distinct()
    wanted = files.select("path").distinct().select("path", F.explode(F.array(F.lit(dv.T1).cast("long"), F.lit(dv.T2).cast("long"))).alias("at"))
    return sn.blobs(wanted, files)


def working_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between a tree and a derived working copy of it, renames by equal content."""
    base = _tree(spark, d, dv.T2)
    b = dv.bucket(F.col("path"), 8)
    work = base.filter(b != 0).select(F.when(b == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(b == 2, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    extra = base.filter(b == 3).select(F.concat(F.lit("new/"), "path").alias("path"), F.concat("content_hash", F.lit("n")).alias("content_hash"))
    return sn.tree_changes(base, work.union(extra))


def branch_commits(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty commits of each repository's claims that are not on the first one."""
    e = read(spark, d, "edges").select("repo", "valid_from", F.explode("evidence.commit").alias("commit")).filter("commit is not null")
    rows = e.groupBy(F.col("repo").alias("branch"), "commit").agg(F.max("valid_from").alias("seq"))
    return sn.own_commits(rows, rows.agg(F.min("branch").alias("branch")), 20)


def grounded_merge_requests(spark: SparkSession, d: str) -> DataFrame:
    """Merge requests that texts name by number and that the first half did not know."""
    mrs = read(spark, d, "documents").filter("artifact_kind = 'merge_request'").select("external_id", F.regexp_extract("external_id", r"(\d+)$", 1).alias("iid"), "updated_at").distinct()
    refs = read(spark, d, "jira_comments").select(F.inline(text.references(F.col("body")))).filter("kind in ('merge_request_number', 'issue_number')").select(F.col("value").alias("iid"))
    known = mrs.filter(F.col("updated_at") < _half()).select("external_id")
    none = refs.select(F.lit("").alias("branch")).limit(0)
    return sn.grounded_requests(mrs.withColumn("branch", F.lit(None).cast("string")).withColumn("shas", F.array().cast("array<string>")), refs, none, none.withColumnRenamed("branch", "sha"), known).select("external_id")


def unavailable_keys(spark: SparkSession, d: str) -> DataFrame:
    """Issue keys that links name and no fetch of the first half brought."""
    issues = read(spark, d, "jira_issues")
    return store.unreferenced(issue_links(issues).select(F.col("b").alias("key")).distinct(), "key", issues.filter(F.col("fetched_at") < _half()), "issue_key")


def neighbor_states(spark: SparkSession, d: str) -> DataFrame:
    """What each neighbour offers and when it last changed; whether its snapshot is fresh."""
    return st.neighbor_states(read(spark, d, "endpoints"), HALF)


def call_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on ambiguous call shapes, taken over by later ones."""
    ends = read(spark, d, "endpoints").select(F.concat_ws(" ", "method", "path").alias("shape"), F.col("source_repo").alias("neighbor"), F.col("published_at").alias("at")).distinct()
    return store.upsert(ends.filter(F.col("at") < _half()), ends.filter(F.col("at") >= _half()), ["shape"], ["at", "neighbor"]).select("shape", "neighbor")


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories and commits that claims name, each once."""
    e = read(spark, d, "edges").select("repo", F.explode("evidence.commit").alias("commit")).filter("commit is not null")
    rows = store.create_missing(e.select("repo", "commit").limit(0), e, ["repo", "commit"])
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"))


def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sources that evidence names: those of the first half, and what the second half adds."""
    e = read(spark, d, "edges").select("recorded_at", F.explode("evidence").alias("x")).select("recorded_at", F.col("x.uri").alias("uri"), F.md5("x.uri").alias("hash"))
    first = e.filter(F.col("recorded_at") < _half()).select("uri", "hash").distinct()
    return store.create_missing(first, e.filter(F.col("recorded_at") >= _half()).select("uri", "hash"), ["uri", "hash"]).groupBy(F.substring("hash", 1, 1).alias("part")).agg(F.count(F.lit(1)).alias("sources"))


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Health of each repository and how many notices and actions follow from it."""
    intents = load(spark, d).nodes.filter(F.col("kind").isin(*INTENTS))
    return st.health(freshness(spark, d), stale_claims(spark, d), unmapped_intents(spark, d), intents)


def derived_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Statements of derived migrations of all tables: entity, operation, column and type."""
    t = load(spark, d).nodes.filter("kind = 'db_entity'").select(F.col("identifier").alias("e"), F.xxhash64("identifier").alias("id"))
    sql = F.concat(F.lit("-- +goose Up\nCREATE TABLE "), "e", F.lit(" (id BIGINT PRIMARY KEY, note TEXT NOT NULL);\nALTER TABLE "), "e", F.lit(" ADD COLUMN extra INT;\nALTER TABLE "), "e", F.lit(" DROP COLUMN note;\n-- +goose Down\nDROP TABLE "), "e", F.lit(";\n"))
    return ddl.operations(t.select("id", sql.alias("text")), "id", "text").select("entity", "op", "column", "data_type")


def owner_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Symbols below the derived owner that their path names, per owner."""
    n = load(spark, d).nodes.filter("kind = 'code_symbol'").select(F.regexp_replace("identifier", "::", ".").alias("path"), "stable_key")
    owner = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    return n.filter(owner != "").groupBy(owner.alias("owner")).agg(F.count(F.lit(1)).alias("symbols"))


def derived_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Symbols below their owners, which stand beside them as derived symbols of the file."""
    n = load(spark, d).nodes.filter("kind = 'code_symbol' and file_path is not null")
    own = n.select("stable_key", "file_path", F.regexp_replace("identifier", "::", ".").alias("path"))
    owner = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    made = own.select("file_path", owner.alias("path")).filter("path <> ''").distinct().select(F.concat_ws("|", F.lit("owner"), "file_path", "path").alias("stable_key"), "file_path", "path")
    return graph_queries.nested(own.unionByName(made))


def derived_renames(spark: SparkSession, d: str) -> DataFrame:
    """Renames inside files between the symbols and their derived second state."""
    sym = dv.symbols(load(spark, d))
    after = dv.later(sym)
    part = lambda df, other, name: df.join(other.select("file_path", "canonical"), ["file_path", "canonical"], "left_anti").select(F.concat_ws("@", "canonical", "kind").alias(name), "file_path", F.col("kind").alias("symbol_kind"), F.col("shape").alias("content_hash")).distinct()
    return graph_queries.renamed(part(sym, after, "old_key"), part(after, sym, "new_key"))


def late_comment_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Comments by project whose issue was not fetched in the first half."""
    known = read(spark, d, "jira_issues").filter(F.col("fetched_at") < _half()).select("issue_key").distinct()
    rows = read(spark, d, "jira_comments").select("comment_id", "issue_key").distinct().join(known, "issue_key", "left_anti")
    return rows.groupBy(F.split("issue_key", "-")[0].alias("project")).agg(F.count(F.lit(1)).alias("comments"), F.countDistinct("issue_key").alias("issues"))


def grafted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidate links between symbols and intents over the claims laid upon current nodes, by relation."""
    found = scoring.link_candidates(dv.grafted(load(spark, d)), 3000)
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("links"), F.sum("score").cast("long").alias("points"), F.max("score").alias("most"), F.sum("test").cast("long").alias("test"), F.sum("data").cast("long").alias("data"), F.sum("lexical").cast("long").alias("lexical"))


QUERIES = {
    f.__name__: f
    for f in (
        document_drift, drift_suggestions, repaired_links, stale_rejects, recorded_verdicts, reactivated_claims, candidate_decisions, offered_candidates, cascade_delete, first_free_ids, claim_batches, document_anchors, confirmed_anchors,
        new_decisions, tree_paths, batch_blobs, working_changes, branch_commits, grounded_merge_requests, unavailable_keys, neighbor_states, call_overrides, repositories, source_rows, index_health, derived_ddl, owner_nesting, derived_nesting, derived_renames,
        late_comment_orphans, grafted_scores,
    )
}

from lodestone.plans.artifact_queries import ORACLE as _ART  # noqa: E402
from lodestone.plans.change_queries import ORACLE as _CHANGE  # noqa: E402
from lodestone.plans.graph_queries import ORACLE as _GRAPH, GRAPH  # noqa: E402
from lodestone.plans.text_queries import _refs  # noqa: E402

_BARE = "regexp_replace(identifier, '_[a-z0-9]{3}$', '')"
_TAIL = "regexp_extract({}, '([^.:]+)$', 1)"
_DL = "dl AS (SELECT DISTINCT trim(stable_key) AS document, a.symbol AS symbol, a.fingerprint AS fingerprint, a.ordinal AS ordinal FROM (SELECT stable_key, unnest(anchors) AS a FROM nodes WHERE anchors IS NOT NULL))"
_DRIFT = f"""WITH {GRAPH}, {_DL.replace("dl AS", "dl0 AS")}, dl AS (SELECT DISTINCT document, regexp_replace(symbol, '_[^.]*$', '') AS symbol FROM dl0), cu AS (SELECT DISTINCT {_BARE} AS name, stable_key AS key, {dv.bucket_sql('content_hash', 400)}::VARCHAR AS shape FROM n WHERE kind = 'code_symbol'),
 pa AS (SELECT DISTINCT {_BARE} AS name, {dv.bucket_sql('content_hash', 400)}::VARCHAR AS shape FROM nodes WHERE kind = 'code_symbol' AND retired_commit IS NOT NULL),
 br AS (SELECT DISTINCT document, symbol FROM dl WHERE symbol NOT IN (SELECT name FROM cu)), sh AS (SELECT shape, min(name) AS by_shape FROM cu GROUP BY shape HAVING count(*) = 1),
 wa AS (SELECT pa.name AS symbol, min(by_shape) AS by_shape FROM pa JOIN sh USING (shape) GROUP BY 1 HAVING count(DISTINCT by_shape) = 1), tl AS (SELECT tail, count(*) AS tails, min(name) AS by_tail FROM (SELECT DISTINCT {_TAIL.format('name')} AS tail, name FROM cu) GROUP BY tail),
 dr AS (SELECT document, br.symbol, CASE WHEN by_shape IS NOT NULL THEN 'R1' WHEN tails = 1 THEN 'R2' WHEN tails > 1 THEN 'R3' ELSE 'R4' END AS class, CASE WHEN by_shape IS NOT NULL THEN by_shape WHEN tails = 1 THEN by_tail END AS target
 FROM br LEFT JOIN wa USING (symbol) LEFT JOIN tl ON tl.tail = {_TAIL.format('br.symbol')})"""
_INF = f"WITH {GRAPH}, c AS (SELECT * FROM e WHERE claim_class = 'inference' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY fingerprint) = 1)"
_QUEUE = f"q AS (SELECT DISTINCT external_id AS id, {dv.bucket_sql('external_id', 4)} AS b FROM documents WHERE artifact_kind IN ('requirement','decision'))"
_OCC = f"oc AS (SELECT symbol, fingerprint, unnest(range(1, {dv.bucket_sql('symbol || fingerprint', 3)} + 1)) AS line FROM (SELECT DISTINCT symbol, fingerprint FROM dl))"
_CONF = f"""it AS (SELECT DISTINCT a.symbol AS symbol, a.fingerprint AS fingerprint, a.ordinal AS ordinal FROM (SELECT unnest(anchors) AS a FROM nodes WHERE kind IN ('feature','requirement','invariant','decision') AND lower(trim(status)) IN ('active','accepted','approved')) WHERE a.ordinal >= 1),
 cf AS (SELECT it.* FROM it JOIN (SELECT symbol, fingerprint, count(*) AS k FROM oc GROUP BY 1, 2) x USING (symbol, fingerprint) WHERE ordinal <= k)"""
_TREE = lambda at: f"(SELECT path, arg_max(content_hash, (commit_seq, content_hash)) AS content_hash FROM source_files WHERE commit_seq <= {at} GROUP BY path)"

ORACLE = {
    "document_drift": f"{_DRIFT} SELECT * FROM dr",
    "drift_suggestions": f"""{_DRIFT}, few AS (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY name)::INT AS rank FROM (SELECT DISTINCT {_TAIL.format('name')} AS tail, name FROM cu) QUALIFY rank <= 5)
 SELECT document, symbol, rank, name FROM dr JOIN few ON few.tail = {_TAIL.format('symbol')}""",
    "repaired_links": f"{_DRIFT} SELECT DISTINCT document, coalesce(t.target, l.symbol) AS symbol FROM (SELECT DISTINCT document, symbol FROM dl) l LEFT JOIN (SELECT * FROM dr WHERE class IN ('R1','R2')) t USING (document, symbol)",
    "stale_rejects": f"""{dv.BASE}, g AS (SELECT fingerprint, src, dst, kind, status FROM e UNION ALL SELECT src || ':' || kind || ':' || dst, src, dst, kind, status FROM gcl)
 SELECT DISTINCT fingerprint, dst AS document, src AS symbol FROM g WHERE status = 'rejected' AND kind IN ('implements','enforces','satisfies','covered_by','depends_on') AND dst IN (SELECT stable_key FROM n WHERE kind IN ('feature','requirement','invariant','decision'))""",
    "recorded_verdicts": f"""{_INF}, v AS (SELECT *, {dv.bucket_sql('fingerprint', 3)} AS b, {dv.bucket_sql('fingerprint', 10)} = 5 AS twice FROM c), a AS (SELECT CASE b WHEN 0 THEN 'assertion' ELSE 'inference' END AS claim_class, CASE b WHEN 0 THEN 'human' ELSE source_kind END AS source_kind,
 CASE b WHEN 0 THEN 'active' ELSE 'rejected' END AS status, 'verification' AS producer, 5000 AS valid_from FROM v WHERE b < 2 AND NOT twice)
 SELECT claim_class, source_kind, status, producer, count(*) AS claims, max(valid_from) AS newest FROM (SELECT claim_class, source_kind, status, producer, valid_from FROM c UNION ALL SELECT * FROM a) GROUP BY ALL""",
    "reactivated_claims": f"WITH {GRAPH} SELECT DISTINCT fingerprint, 'active' AS status, NULL AS stale_reason, 'checked' AS annotation FROM e WHERE status = 'stale' AND {dv.bucket_sql('fingerprint', 2)} = 0",
    "candidate_decisions": f"WITH {_QUEUE} SELECT CASE b WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS state, count(*) AS n FROM q GROUP BY 1",
    "offered_candidates": f"WITH {_QUEUE} SELECT id FROM q WHERE b <> 1",
    "cascade_delete": f"""WITH g AS (SELECT DISTINCT issue_key AS id FROM jira_issues WHERE {dv.bucket_sql('issue_key', 10)} = 0) SELECT 'issues' AS part, count(DISTINCT issue_key) AS rows FROM jira_issues WHERE issue_key NOT IN (SELECT id FROM g)
 UNION ALL SELECT 'links', count(*) FROM ({_ART['issue_links']}) WHERE a NOT IN (SELECT id FROM g) AND b NOT IN (SELECT id FROM g) UNION ALL SELECT 'ledger', count(*) FROM (SELECT DISTINCT ledger_id, external_id FROM analyzed_inputs WHERE kind = 'issue') WHERE external_id NOT IN (SELECT id FROM g)""",
    "first_free_ids": """WITH p AS (SELECT DISTINCT regexp_extract(issue_key, '^(.*)-\\d+$', 1) AS stem, regexp_extract(issue_key, '-(\\d+)$', 1)::BIGINT AS n FROM jira_issues), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM p)
 SELECT stem, coalesce(min(k) FILTER (n <> k), max(k) + 1) AS number FROM k GROUP BY stem""",
    "claim_batches": f"""WITH {GRAPH}, o AS (SELECT fingerprint, {dv.bucket_sql('fingerprint', 16)} AS part, strlen(fingerprint) AS size FROM (SELECT DISTINCT fingerprint FROM e WHERE status = 'stale')), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY fingerprint) AS k FROM o),
 w(part, k, fingerprint, size, rows, bytes, batch) AS (SELECT part, k, fingerprint, size, 1, size, 1 FROM r WHERE k = 1 UNION ALL SELECT r.part, r.k, r.fingerprint, r.size, CASE WHEN w.rows >= 10 OR w.bytes + r.size > 1000 THEN 1 ELSE w.rows + 1 END,
 CASE WHEN w.rows >= 10 OR w.bytes + r.size > 1000 THEN r.size ELSE w.bytes + r.size END, w.batch + CASE WHEN w.rows >= 10 OR w.bytes + r.size > 1000 THEN 1 ELSE 0 END FROM w JOIN r ON r.part = w.part AND r.k = w.k + 1)
 SELECT part, batch, count(*) AS rows, sum(size)::BIGINT AS bytes, min(fingerprint) AS first FROM w GROUP BY part, batch""",
    "document_anchors": f"WITH {_DL} SELECT symbol, fingerprint, ordinal, string_agg(DISTINCT document, ',' ORDER BY document) AS documents FROM dl GROUP BY 1, 2, 3",
    "confirmed_anchors": f"WITH {_DL}, {_OCC}, {_CONF} SELECT * FROM cf",
    "new_decisions": f"""WITH {_DL}, {_OCC}, {_CONF}, bf AS (SELECT symbol, fingerprint, count(*) AS k FROM oc WHERE line = 1 AND {dv.bucket_sql('symbol', 2)} = 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY symbol, fingerprint ORDER BY line) AS ordinal FROM oc)
 SELECT symbol, fingerprint, ordinal::INT AS ordinal, line::INT AS line FROM o LEFT JOIN bf USING (symbol, fingerprint) WHERE ordinal > coalesce(k, 0) AND (symbol, fingerprint, ordinal) NOT IN (SELECT (symbol, fingerprint, ordinal) FROM cf)""",
    "tree_paths": f"SELECT path, content_hash FROM {_TREE(dv.T1)}",
    "batch_blobs": f"""WITH f AS (SELECT path, commit_seq, max(length(text)) AS chars FROM source_files GROUP BY 1, 2), w AS (SELECT DISTINCT path, unnest([{dv.T1}, {dv.T2}])::BIGINT AS at FROM source_files)
 SELECT w.path, "at", arg_max(chars, commit_seq) AS chars FROM w LEFT JOIN f ON f.path = w.path AND f.commit_seq <= "at" GROUP BY 1, 2""".replace(" AS at FROM", ' AS "at" FROM'),
    "working_changes": f"""WITH b AS (SELECT *, {dv.bucket_sql('path', 8)} AS k FROM {_TREE(dv.T2)}), w AS (SELECT CASE k WHEN 1 THEN path || '.new' ELSE path END AS path, CASE k WHEN 2 THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM b WHERE k <> 0
 UNION ALL SELECT 'new/' || path, content_hash || 'n' FROM b WHERE k = 3), gone AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM w)), come AS (SELECT * FROM w WHERE path NOT IN (SELECT path FROM b)),
 go AS (SELECT content_hash, min(path) AS path FROM gone GROUP BY 1 HAVING count(*) = 1), co AS (SELECT content_hash, min(path) AS path FROM come GROUP BY 1 HAVING count(*) = 1), rn AS (SELECT go.path AS old_path, co.path AS new_path FROM go JOIN co USING (content_hash))
 SELECT 'renamed' AS op, old_path, new_path FROM rn UNION ALL SELECT 'deleted', path, NULL FROM gone WHERE path NOT IN (SELECT old_path FROM rn) UNION ALL SELECT 'added', NULL, path FROM come WHERE path NOT IN (SELECT new_path FROM rn)
 UNION ALL SELECT 'modified', b.path, b.path FROM b JOIN w USING (path) WHERE b.content_hash <> w.content_hash""",
    "branch_commits": """WITH c AS (SELECT repo AS branch, x.commit AS commit, max(valid_from) AS seq FROM (SELECT repo, valid_from, unnest(evidence) AS x FROM edges) WHERE x.commit IS NOT NULL GROUP BY 1, 2)
 SELECT branch, commit, row_number() OVER (PARTITION BY branch ORDER BY seq DESC, commit)::INT AS rank FROM c WHERE branch <> (SELECT min(branch) FROM c) AND commit NOT IN (SELECT commit FROM c WHERE branch = (SELECT min(branch) FROM c)) QUALIFY rank <= 20""",
    "grounded_merge_requests": f"""WITH r AS (SELECT DISTINCT value FROM ({_refs('jira_comments', 'comment_id', 'body')}) WHERE kind IN ('merge_request_number','issue_number'))
 SELECT DISTINCT external_id FROM documents WHERE artifact_kind = 'merge_request' AND regexp_extract(external_id, '(\\d+)$', 1) IN (SELECT value FROM r) AND external_id NOT IN (SELECT external_id FROM documents WHERE artifact_kind = 'merge_request' AND updated_at < TIMESTAMP '2025-01-01')""",
    "unavailable_keys": f"SELECT DISTINCT b AS key FROM ({_ART['issue_links']}) WHERE b NOT IN (SELECT issue_key FROM jira_issues WHERE fetched_at < TIMESTAMP '2025-01-01')",
    "neighbor_states": """SELECT source_repo AS neighbor, count(*) AS endpoints, count(*) FILTER (withdrawn_at IS NULL) AS offered, max(published_at) AS newest, CASE WHEN count(*) FILTER (withdrawn_at IS NULL) = 0 THEN 'empty' WHEN max(published_at) >= TIMESTAMP '2025-01-01' THEN 'changed' ELSE 'current' END AS state
 FROM (SELECT DISTINCT source_repo, method, path, published_at, withdrawn_at FROM endpoints) GROUP BY 1""",
    "call_overrides": """SELECT shape, neighbor FROM (SELECT DISTINCT method || ' ' || path AS shape, source_repo AS neighbor, published_at FROM endpoints) QUALIFY row_number() OVER (PARTITION BY shape ORDER BY published_at >= TIMESTAMP '2025-01-01' DESC, published_at DESC, neighbor DESC) = 1""",
    "repositories": "SELECT repo, count(DISTINCT x.commit) AS commits FROM (SELECT repo, unnest(evidence) AS x FROM edges) WHERE x.commit IS NOT NULL GROUP BY repo",
    "source_rows": "SELECT md5(uri)[1:1] AS part, count(*) AS sources FROM (SELECT DISTINCT x.uri AS uri FROM (SELECT unnest(evidence) AS x FROM edges)) GROUP BY 1",
    "index_health": f"""WITH f AS ({_CHANGE['freshness']}), s AS (SELECT count(*) AS stale FROM ({_GRAPH['stale_claims']})), u AS (SELECT count(*) AS unmapped FROM ({_GRAPH['unmapped_intents']})), i AS (SELECT count(*) AS intents FROM ({_GRAPH['current_nodes']}) WHERE kind IN ('feature','requirement','invariant','decision'))
 SELECT repo, CASE WHEN freshness <> 'current' THEN 'needs_index' WHEN stale > 0 THEN 'needs_attention' WHEN intents = 0 THEN 'needs_context' WHEN unmapped > 0 THEN 'needs_mappings' ELSE 'ready' END AS health,
 CASE freshness WHEN 'not_indexed' THEN 'No commit has been indexed.' WHEN 'behind' THEN 'The graph is behind the newest commit.' ELSE CASE WHEN stale > 0 THEN stale || ' semantic relationships are stale.' WHEN intents = 0 THEN 'No documents are indexed.' WHEN unmapped > 0 THEN unmapped || ' documents have no active mapping.' ELSE '' END END AS notice FROM f, s, u, i""",
    "derived_ddl": f"""WITH {GRAPH} SELECT identifier AS entity, unnest(['create','add','add','add','drop']) AS op, unnest([NULL,'id','note','extra','note']) AS "column", unnest([NULL,'bigint','text','int',NULL]) AS data_type FROM n WHERE kind = 'db_entity'""",
    "owner_nesting": f"WITH {GRAPH}, p AS (SELECT regexp_extract(replace(identifier, '::', '.'), '^(.*)\\.[^.]*$', 1) AS owner FROM n WHERE kind = 'code_symbol') SELECT owner, count(*) AS symbols FROM p WHERE owner <> '' GROUP BY owner",
    "derived_nesting": f"""WITH {GRAPH}, s0 AS (SELECT stable_key, file_path, replace(identifier, '::', '.') AS path FROM n WHERE kind = 'code_symbol' AND file_path IS NOT NULL), w AS (SELECT DISTINCT file_path, regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS path FROM s0),
 s AS (SELECT * FROM s0 UNION ALL SELECT 'owner|' || file_path || '|' || path, file_path, path FROM w WHERE path <> ''), p AS (SELECT file_path, path, min(stable_key) AS parent FROM s GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT s.stable_key, arg_max(parent, length(p.path)) AS parent FROM s JOIN p ON p.file_path = s.file_path AND starts_with(s.path, p.path || '.') GROUP BY s.stable_key""",
    "derived_renames": f"""{dv.BASE}, o AS (SELECT file_path, kind, shape, min(canonical || '@' || kind) AS old_key FROM (SELECT DISTINCT * FROM sym s WHERE NOT EXISTS (SELECT 1 FROM nxt a WHERE a.file_path = s.file_path AND a.canonical = s.canonical)) GROUP BY 1, 2, 3 HAVING count(DISTINCT canonical) = 1),
 w AS (SELECT file_path, kind, shape, min(canonical || '@' || kind) AS new_key FROM nxt a WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE a.file_path = s.file_path AND a.canonical = s.canonical) GROUP BY 1, 2, 3 HAVING count(DISTINCT canonical) = 1)
 SELECT file_path, old_key, new_key FROM o JOIN w USING (file_path, kind, shape) WHERE old_key <> new_key""",
    "late_comment_orphans": """SELECT string_split(issue_key, '-')[1] AS project, count(*) AS comments, count(DISTINCT issue_key) AS issues FROM (SELECT DISTINCT comment_id, issue_key FROM jira_comments)
 WHERE issue_key NOT IN (SELECT issue_key FROM jira_issues WHERE fetched_at < TIMESTAMP '2025-01-01') GROUP BY 1""",
}
_REST = _ART["link_score"].split(GRAPH, 1)[1].replace(" FROM e ", " FROM eg ").replace("FROM around", "FROM arg").replace("FROM e x", "FROM eg x")
ORACLE["grafted_scores"] = f"""{dv.BASE}, eg AS (SELECT src, dst, kind, claim_class, status FROM e UNION ALL SELECT src, dst, kind, 'assertion', status FROM gcl),
 arg AS (SELECT src AS here, dst AS there, kind, status FROM eg UNION ALL SELECT dst, src, kind, status FROM eg WHERE src <> dst){_REST.split(' SELECT *, lexical + structural')[0]}
 SELECT relation, count(*) AS links, sum(score)::BIGINT AS points, max(score) AS most, sum(test)::BIGINT AS test, sum(data)::BIGINT AS data, sum(lexical)::BIGINT AS lexical FROM (SELECT *, lexical + structural + test + data AS score FROM sc) WHERE score >= 3000 GROUP BY relation"""
