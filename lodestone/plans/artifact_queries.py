"""Queries on artifacts, links, scope and candidate scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import artifacts, graph as g, scoring
from lodestone.operators.increments import instant
from lodestone.plans.text_queries import reference_links
from lodestone.session import materialise, read
from lodestone.sources.graph import load


def latest_issues(spark: SparkSession, d: str) -> DataFrame:
    """The newest fetched version of every issue."""
    rows = read(spark, d, "jira_issues").select("issue_key", "fetched_at", "issue_id", "project_key", "summary", "parent_key")
    return artifacts.latest(rows, "issue_key", ["fetched_at", "issue_id"]).select("issue_key", "issue_id", "project_key", "summary", "parent_key")


def issue_links(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.issue_links(read(spark, d, "jira_issues"))


def issue_depths(spark: SparkSession, d: str) -> DataFrame:
    """Issues that documents name, and those at most two links away."""
    direct = materialise(reference_links(spark, d).select(F.col("issue_key").alias("key")), "direct")
    return artifacts.related(direct, artifacts.issue_links(read(spark, d, "jira_issues")), 2)


def issue_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of issues that links connect, by their least key."""
    return g.components(artifacts.issue_links(read(spark, d, "jira_issues")))


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.split("source", ":")[0].alias("provider"), F.col("artifact_kind").alias("kind"), F.lit(None).cast("string").alias("parent")
    )
    issues = read(spark, d, "jira_issues").select(F.col("issue_key").alias("id"), F.lit("jira").alias("provider"), F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("parent"))
    comments = read(spark, d, "jira_comments").select(
        F.concat(F.lit("comment:"), F.col("comment_id")).alias("id"), F.lit("jira").alias("provider"), F.lit("comment").alias("kind"), F.col("issue_key").alias("parent")
    )
    return docs.union(issues).union(comments).distinct()


def scope_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which artifacts stay in scope and why, counted."""
    named = materialise(reference_links(spark, d), "named")
    depths = artifacts.related(named.select(F.col("issue_key").alias("key")), artifacts.issue_links(read(spark, d, "jira_issues")), 2)
    links = named.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("issue_key").alias("issue"))
    plan = artifacts.scope_plan(_artifacts(spark, d), links, depths)
    return plan.groupBy("provider", "kind", "disposition", "reason").agg(F.count(F.lit(1)).alias("n"))


def comment_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest twenty comments of each issue."""
    rows = read(spark, d, "jira_comments").select("issue_key", "comment_id", instant(F.coalesce("updated", "created")).alias("at"))
    newest = rows.groupBy("issue_key", "comment_id").agg(F.max("at").alias("at"))
    return artifacts.history(newest, "issue_key", "at", "comment_id").select("issue_key", "comment_id", "rank")


def comment_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Comments by project whose issue was never fetched."""
    known = read(spark, d, "jira_issues").select("issue_key").distinct()
    rows = read(spark, d, "jira_comments").select("comment_id", "issue_key").distinct().join(known, "issue_key", "left_anti")
    return rows.groupBy(F.split("issue_key", "-")[0].alias("project")).agg(F.count(F.lit(1)).alias("comments"), F.countDistinct("issue_key").alias("issues"))


def issue_activity(spark: SparkSession, d: str) -> DataFrame:
    """Issues, comments and versions per project, with a total."""
    rows = read(spark, d, "jira_comments").select("issue_key", "comment_id", "fetch_id").distinct().withColumn("project", F.split("issue_key", "-")[0])
    return rows.rollup("project").agg(F.countDistinct("issue_key").alias("issues"), F.countDistinct("comment_id").alias("comments"), F.count(F.lit(1)).alias("versions"))


def changed_symbol_links(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in the files that the commits of open claims' evidence touch, sweeps left out."""
    graph = load(spark, d)
    evidence = read(spark, d, "edges").filter("valid_to is null").select(F.explode("evidence").alias("e")).select(F.col("e.commit").alias("commit"), F.col("e.uri").alias("path")).filter("commit is not null")
    symbols = graph.nodes.filter("kind = 'code_symbol'").select("file_path", "stable_key")
    threshold = symbols.agg(F.greatest(F.lit(20), F.round(F.countDistinct("file_path") * 0.1)).cast("long").alias("threshold"))
    return artifacts.symbol_links(evidence, symbols, threshold)


def evidence_commits(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of open claims per source kind: rows, commits, mean and least strength."""
    rows = read(spark, d, "edges").filter("valid_to is null").dropDuplicates(["edge_id"]).select(F.explode("evidence").alias("e"))
    return rows.groupBy(F.col("e.source_kind").alias("source_kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("e.commit").alias("commits"), F.round(F.avg("e.strength"), 6).alias("mean"), F.min("e.strength").alias("least")
    )


def link_score(spark: SparkSession, d: str) -> DataFrame:
    """Candidate links between symbols and intents with at least 3000 points, by signal."""
    return scoring.link_candidates(load(spark, d), 3000)


def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Symbols already tied to each intent, whatever the state of the claim."""
    edges = load(spark, d).edges.filter(F.col("kind").isin("implements", "enforces", "satisfies", "covered_by", "depends_on"))
    return edges.groupBy("dst", "kind").agg(F.countDistinct("src").alias("symbols"), F.count_if(F.col("status") == "active").alias("active"))


def short_references(spark: SparkSession, d: str) -> DataFrame:
    """Issue and merge request numbers in the newest comment versions, by kind."""
    rows = read(spark, d, "jira_comments").select("comment_id", "fetch_id", instant(F.coalesce("updated", "created")).alias("at"), text.references(F.col("body")).alias("refs"))
    rows = artifacts.latest(rows, "comment_id", ["at", "fetch_id"]).select("comment_id", F.inline("refs")).distinct()
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("value").alias("values"))


QUERIES = {
    f.__name__: f
    for f in (
        latest_issues, issue_links, issue_depths, issue_components, scope_plan, comment_history, comment_orphans, issue_activity, changed_symbol_links, evidence_commits,
        link_score, semantic_pairs, short_references,
    )
}

from lodestone.plans.graph_queries import GRAPH  # noqa: E402
from lodestone.plans.text_queries import _IT, ORACLE as _TEXT, _refs, _words  # noqa: E402

_LINKS = """li AS (SELECT DISTINCT issue_key AS a, unnest(list_distinct(list_concat(linked_keys, CASE WHEN parent_key IS NULL THEN [] ELSE [parent_key] END))) AS b FROM jira_issues),
 l AS (SELECT * FROM li WHERE a <> b), ar AS (SELECT a, b FROM l UNION SELECT b, a FROM l)"""
_DEPTHS = f"""{_LINKS}, direct AS (SELECT DISTINCT issue_key AS key FROM ({_TEXT['reference_links']})), dw AS (SELECT key, 0 AS depth FROM direct UNION SELECT b, depth + 1 FROM dw JOIN ar ON a = key WHERE depth < 2),
 dp AS (SELECT key, min(depth) AS depth FROM dw GROUP BY key)"""
_AT = r"CAST(regexp_replace(replace(coalesce(updated, created), 'Z', '+00:00'), '([+-]\d\d)(\d\d)$', '\1:\2') AS TIMESTAMPTZ)"

ORACLE = {
    "latest_issues": "SELECT issue_key, issue_id, project_key, summary, parent_key FROM jira_issues QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY fetched_at DESC, issue_id DESC) = 1",
    "issue_links": f"WITH {_LINKS} SELECT DISTINCT a, b FROM l",
    "issue_depths": f"WITH RECURSIVE {_DEPTHS} SELECT key, depth FROM dp",
    "issue_components": f"WITH RECURSIVE {_LINKS}, w AS (SELECT a AS key, a AS root FROM ar UNION SELECT w.key, ar.b FROM w JOIN ar ON w.root = ar.a) SELECT key, min(root) AS root FROM w GROUP BY key",
    "scope_plan": f"""WITH RECURSIVE {_DEPTHS}, rl AS ({_TEXT['reference_links']}),
 art AS (SELECT 'doc:' || doc_id AS id, string_split(source, ':')[1] AS provider, artifact_kind AS kind, NULL::VARCHAR AS parent FROM documents UNION SELECT issue_key, 'jira', 'issue', NULL FROM jira_issues
 UNION SELECT 'comment:' || comment_id, 'jira', 'comment', issue_key FROM jira_comments),
 j AS (SELECT art.*, x.depth, p.key IS NOT NULL AS pk, id IN (SELECT 'doc:' || doc_id FROM rl JOIN dp ON key = issue_key) AS anchored FROM art LEFT JOIN dp x ON x.key = id LEFT JOIN dp p ON p.key = parent),
 k AS (SELECT *, CASE WHEN anchored AND provider = 'git' THEN 'business_anchored_git' WHEN anchored AND kind IN ('merge_request','pull_request') THEN 'repository_linked_merge_request' WHEN depth = 0 THEN 'direct_jira_reference'
 WHEN depth > 0 THEN 'related_jira_issue:' || depth WHEN pk THEN 'retained_parent' WHEN provider = 'git' OR kind IN ('merge_request','pull_request') THEN 'no_business_anchor'
 WHEN provider = 'jira' AND kind = 'issue' THEN 'jira_not_referenced_by_repository' WHEN parent IS NOT NULL THEN 'parent_not_retained' ELSE 'unsupported_in_business_scope' END AS reason FROM j)
 SELECT provider, kind, CASE WHEN reason IN ('business_anchored_git','repository_linked_merge_request','direct_jira_reference','retained_parent') OR starts_with(reason, 'related_jira_issue') THEN 'keep' ELSE 'prune' END AS disposition,
 reason, count(*) AS n FROM k GROUP BY ALL""",
    "comment_history": f"""WITH r AS (SELECT issue_key, comment_id, max({_AT}) AS moment FROM jira_comments GROUP BY ALL)
 SELECT issue_key, comment_id, row_number() OVER (PARTITION BY issue_key ORDER BY moment DESC NULLS LAST, comment_id DESC)::INT AS rank FROM r QUALIFY rank <= 20""",
    "comment_orphans": """SELECT string_split(issue_key, '-')[1] AS project, count(*) AS comments, count(DISTINCT issue_key) AS issues FROM (SELECT DISTINCT comment_id, issue_key FROM jira_comments)
 WHERE issue_key NOT IN (SELECT issue_key FROM jira_issues) GROUP BY 1""",
    "issue_activity": """SELECT project, count(DISTINCT issue_key) AS issues, count(DISTINCT comment_id) AS comments, count(*) AS versions
 FROM (SELECT DISTINCT issue_key, comment_id, fetch_id, string_split(issue_key, '-')[1] AS project FROM jira_comments) GROUP BY ROLLUP (project)""",
    "changed_symbol_links": f"""WITH {GRAPH}, ev AS (SELECT unnest(evidence) AS x FROM edges WHERE valid_to IS NULL), ch AS (SELECT DISTINCT x.commit AS commit, x.uri AS path FROM ev WHERE x.commit IS NOT NULL),
 th AS (SELECT greatest(20, round(count(DISTINCT file_path) * 0.1)) AS threshold FROM n WHERE kind = 'code_symbol'), ok AS (SELECT commit FROM ch GROUP BY commit HAVING count(*) <= (SELECT threshold FROM th))
 SELECT DISTINCT commit, stable_key FROM ch JOIN n ON file_path = path AND kind = 'code_symbol' WHERE commit IN (SELECT commit FROM ok)""",
    "evidence_commits": """WITH d AS (SELECT edge_id, any_value(evidence) AS evidence FROM edges WHERE valid_to IS NULL GROUP BY edge_id), ev AS (SELECT unnest(evidence) AS x FROM d)
 SELECT x.source_kind AS source_kind, count(*) AS rows, count(DISTINCT x.commit) AS commits, round(avg(x.strength), 6) AS mean, min(x.strength) AS least FROM ev GROUP BY 1""",
    "semantic_pairs": f"WITH {GRAPH} SELECT dst, kind, count(DISTINCT src) AS symbols, count(*) FILTER (status = 'active') AS active FROM e WHERE kind IN ('implements','enforces','satisfies','covered_by','depends_on') GROUP BY dst, kind",
    "short_references": f"""WITH newest AS (SELECT comment_id, body FROM jira_comments QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY {_AT} DESC NULLS LAST, fetch_id DESC) = 1)
 SELECT kind, count(*) AS refs, count(DISTINCT value) AS "values" FROM ({_refs('newest', 'comment_id', 'body')}) GROUP BY kind""",
    "link_score": f"""WITH {GRAPH}, {_IT}, sy AS (SELECT stable_key AS symbol, file_path, list_filter({_words("concat_ws(' ', identifier, name, signature)", 3)}, lambda w: NOT list_contains(['the','and','for','with','that','this','from','must','shall','should','are'], w)) AS ts
 FROM n WHERE kind = 'code_symbol' AND NOT is_test),
 vf AS (SELECT DISTINCT src AS known, dst AS intent FROM e WHERE claim_class = 'assertion' AND status = 'active' AND kind IN ('implements','enforces','satisfies','depends_on')),
 ca AS (SELECT DISTINCT here, there, status FROM around WHERE kind = 'calls'),
 st AS (SELECT intent, symbol, max(s) AS s FROM (SELECT intent, there AS symbol, 10 AS s FROM vf JOIN ca ON known = here WHERE status = 'active'
 UNION ALL SELECT intent, symbol, 6 FROM vf JOIN n ON n.stable_key = known JOIN sy ON sy.file_path = n.file_path) GROUP BY 1, 2),
 te AS (SELECT DISTINCT x.src AS intent, ca.here AS symbol FROM e x JOIN n ON n.stable_key = x.dst AND n.is_test JOIN ca ON ca.there = x.dst WHERE x.kind = 'covered_by'),
 ac AS (SELECT DISTINCT src, dst, kind FROM e WHERE kind IN ('reads_from','writes_to') AND status = 'active'),
 da AS (SELECT vf.intent, b.src AS symbol, max(CASE WHEN a.kind = b.kind THEN 10 ELSE 6 END) AS d FROM vf JOIN ac a ON a.src = vf.known JOIN ac b ON b.dst = a.dst GROUP BY 1, 2),
 sc AS (SELECT sy.symbol, it.stable_key AS intent, CASE it.kind WHEN 'invariant' THEN 'enforces' WHEN 'decision' THEN 'satisfies' ELSE 'implements' END AS relation, least(len(list_intersect(ts, it.t)), 4) * 875 AS lexical, coalesce(st.s, 0) * 300 AS structural,
 CASE WHEN te.symbol IS NULL THEN 0 ELSE 1500 END AS test, coalesce(d, 0) * 100 AS data, 0 AS artifact FROM sy CROSS JOIN it LEFT JOIN st ON st.intent = it.stable_key AND st.symbol = sy.symbol LEFT JOIN te ON te.intent = it.stable_key AND te.symbol = sy.symbol
 LEFT JOIN da ON da.intent = it.stable_key AND da.symbol = sy.symbol WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = sy.symbol AND dst = it.stable_key))
 SELECT *, lexical + structural + test + data AS score FROM sc WHERE lexical + structural + test + data >= 3000""",
}
