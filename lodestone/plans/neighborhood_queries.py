"""Queries on neighborhoods, context evidence, column seeds and agent contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.model import SEMANTIC, relation, state
from lodestone.operators import agents, columns, neighborhood as nb
from lodestone.operators.artifacts import issue_links
from lodestone.operators.orphans import clean_key
from lodestone.plans import derived as dv
from lodestone.plans.artifact_queries import changed_symbol_links
from lodestone.plans.text_queries import reference_links
from lodestone.session import materialise, read
from lodestone.sources.graph import Graph, load

CATALOG = ("feature", "requirement", "invariant", "decision", "domain_concept", "event", "api_endpoint", "db_entity")


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """(kind, id, provider, title, body) of issues, comments, commits and documents of the forge."""
    issues = read(spark, d, "jira_issues").groupBy(F.col("issue_key").alias("id")).agg(F.max("summary").alias("title")).select(F.lit("issue").alias("kind"), "id", F.lit("jira").alias("provider"), "title")
    comments = read(spark, d, "jira_comments").select(F.lit("comment").alias("kind"), F.col("comment_id").alias("id"), F.lit("jira").alias("provider"), F.lit("").alias("title")).distinct()
    commits = read(spark, d, "edges").filter("valid_to is null").select(F.explode("evidence.commit").alias("id")).filter("id is not null").distinct().select(F.lit("commit").alias("kind"), "id", F.lit("git").alias("provider"), F.lit("").alias("title"))
    docs = read(spark, d, "documents").filter("artifact_kind in ('merge_request', 'review_comment')").select(F.col("artifact_kind").alias("kind"), F.col("external_id").alias("id"), F.lit("gitlab").alias("provider"), F.lit("").alias("title")).distinct()
    return issues.union(comments).union(commits).union(docs).withColumn("body", F.lit(""))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(src_kind, src, link, target_kind, target) of everything the tables say about artifacts."""
    row = lambda df, sk, s, link, tk, t: df.select(F.lit(sk).alias("src_kind") if isinstance(sk, str) else sk.alias("src_kind"), F.col(s).alias("src"), F.lit(link).alias("link"), F.lit(tk).alias("target_kind"), F.col(t).alias("target"))
    on = row(read(spark, d, "jira_comments"), "comment", "comment_id", "comments_on", "issue", "issue_key")
    related = row(issue_links(read(spark, d, "jira_issues")), "issue", "a", "related_issue", "issue", "b")
    docs = read(spark, d, "documents").filter("artifact_kind in ('merge_request', 'review_comment')").select("doc_id", "external_id", "artifact_kind")
    named = row(reference_links(spark, d).join(docs, "doc_id"), F.col("artifact_kind"), "external_id", "references", "issue", "issue_key")
    code = row(changed_symbol_links(spark, d), "commit", "commit", "changed_symbol", "code_symbol", "stable_key")
    return on.union(related).union(named).union(code).distinct()


def _parts(spark: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    return dv.grafted(load(spark, d)), materialise(nb.symbols_of(links(spark, d)), "own-symbols")


def neighborhood_links(spark: SparkSession, d: str) -> DataFrame:
    """What is linked to each artifact, the strongest twenty."""
    return nb.linked(materialise(links(spark, d), "artifact-links"), artifacts(spark, d))


def neighborhood_symbols(spark: SparkSession, d: str) -> DataFrame:
    graph, own = _parts(spark, d)
    return nb.changed_names(own, graph)


def neighborhood_knowledge(spark: SparkSession, d: str) -> DataFrame:
    """Intents that the symbols of each artifact are claimed to implement."""
    graph, own = _parts(spark, d)
    return nb.knowledge(own, graph)


def neighborhood_tests(spark: SparkSession, d: str) -> DataFrame:
    graph, own = _parts(spark, d)
    return nb.tests_near(own, nb.knowledge(own, graph), graph)


def neighborhood_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of each artifact's neighborhood within 200 tokens."""
    graph, own = _parts(spark, d)
    arts = materialise(artifacts(spark, d), "artifacts")
    near = nb.linked(materialise(links(spark, d), "artifact-links"), arts)
    related = nb.knowledge(own, graph)
    parts = nb.sections(arts, near, nb.changed_names(own, graph), nb.tests_near(own, related, graph), related)
    return nb.rendered(parts, 200)


def ticket_units(spark: SparkSession, d: str) -> DataFrame:
    """What each ticket leads to, breadth first, forty at most."""
    anchors = read(spark, d, "jira_issues").select(F.col("issue_key").alias("anchor"))
    return nb.ticket_units(anchors, links(spark, d), artifacts(spark, d))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "edges").filter("valid_to is null")
    return e.select(
        "edge_id", clean_key(F.col("src")).alias("src"), clean_key(F.col("dst")).alias("dst"), relation(F.col("kind")).alias("kind"), "claim_class", state(F.col("status")).alias("status"), "confidence_bp", "fingerprint", "stale_reason",
        F.transform(F.coalesce("evidence", F.array()), lambda x: F.concat(x["uri"], F.lit("#"), x["locator"])).alias("sources"),
    ).dropDuplicates(["edge_id"]).filter("src is not null and dst is not null")


def context_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Claims between current nodes as evidence of a pack: place by relation, text, sources, doubt."""
    return columns.evidence_rows(_claims(spark, d), load(spark, d).nodes).drop("edge_id")


def column_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Queries ``table.column`` of all tables, and symbols' own dotted names, as seeds."""
    nodes = load(spark, d).nodes
    wanted = nodes.filter("kind = 'db_entity'").select(F.concat("identifier", F.lit(".id")).alias("query")).union(nodes.filter("kind = 'code_symbol'").select("identifier")).distinct()
    return columns.column_seeds(nodes, wanted)


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Claims on tables with the columns that a derived locator names."""
    e = load(spark, d).edges.filter("kind in ('reads_from', 'writes_to', 'defines_schema')")
    locator = F.concat(F.lit("L1 columns: id, c"), dv.bucket(F.col("src"), 3).cast("string"))
    return e.select("src", "dst", F.array(locator).alias("locators"))


def impact_column(spark: SparkSession, d: str) -> DataFrame:
    """Readers of four columns of every table; a column nobody names leaves the table's impact as it is."""
    graph = load(spark, d)
    tables = graph.nodes.select("stable_key", "kind").filter("kind = 'db_entity'").select("stable_key")
    asked = tables.select(F.col("stable_key").alias("dst"), F.explode(F.array(*[F.lit(f"c{n}") for n in range(4)])).alias("column"))
    return columns.column_focus(asked, _located(spark, d), graph.nodes)


def compact_signatures(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d).nodes.filter("kind = 'code_symbol'")
    word = F.element_at(F.array(*map(F.lit, ("def ", "fn ", "func ", "class ", "pub fn "))), (dv.bucket(F.col("stable_key"), 5) + 1).cast("int"))
    sign = F.concat(word, F.col("name"), F.lit("(a: int):"))
    return n.select("stable_key", columns.compact_signature(sign, F.col("name")).alias("short"))


def dashboard_graph(spark: SparkSession, d: str) -> DataFrame:
    """Claims between nodes of the catalogs."""
    graph = load(spark, d)
    keys = graph.nodes.filter(F.col("kind").isin(*CATALOG)).select("stable_key")
    e = graph.edges.join(keys.withColumnRenamed("stable_key", "src"), "src", "left_semi").join(keys.withColumnRenamed("stable_key", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "kind", "status").distinct()


def explain_groups(spark: SparkSession, d: str) -> DataFrame:
    """Claims that touch the nodes of each kind, by relation."""
    graph = load(spark, d)
    keys = graph.nodes.select("stable_key", F.col("kind").alias("node_kind"))
    from lodestone.operators.graph import both_ways

    around = both_ways(graph.edges.select("src", "dst", "kind", "fingerprint")).withColumnRenamed("here", "stable_key")
    return around.join(keys, "stable_key").groupBy("node_kind", "kind").agg(F.countDistinct("fingerprint").alias("claims"), F.countDistinct("stable_key").alias("nodes"))


def condition_weights(spark: SparkSession, d: str) -> DataFrame:
    """Issues by project and the weight of their summary as a condition."""
    i = read(spark, d, "jira_issues").select("issue_key", "project_key", "summary").distinct()
    return i.groupBy("project_key", columns.condition_weight(F.col("summary")).alias("weight")).agg(F.count(F.lit(1)).alias("issues"))


def code_identifiers(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d).nodes.filter("kind = 'code_symbol'")
    return n.select("stable_key", F.array_join(F.array_sort(columns.identifiers(F.concat_ws(" ", "name", "signature"))), ",").alias("terms"))


def docstring_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Triple-quoted blocks of Python files: how many, and their length."""
    files = read(spark, d, "source_files").filter(F.lower("path").endswith(".py") & F.col("text").isNotNull()).select("file_id", "text").distinct()
    blocks = F.regexp_extract_all("text", F.lit(r'(?s)"""(.*?)"""'), 1)
    return files.select("file_id", F.size(blocks).cast("long").alias("blocks"), F.aggregate(blocks, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars")).filter("blocks > 0")


def _judgments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, d, "documents").filter("length(text) > 40").select("external_id", "text", "artifact_kind", dv.bucket(F.col("external_id"), 200).alias("case"), dv.bucket(F.concat("external_id", F.lit("q")), 6).alias("b"))
    kind = F.when(F.col("artifact_kind") == "commit", "code").otherwise("document")
    evidence = docs.select("case", F.col("external_id").alias("id"), kind.alias("kind"), F.col("text").alias("excerpt"), F.when(F.col("artifact_kind").isin("requirement", "decision"), F.col("external_id")).alias("assertion"))
    quote = F.when(F.col("b") == 1, F.concat(F.substring("text", 5, 12), F.lit("\u0001"))).otherwise(F.substring("text", 5, 12))
    cited = docs.filter("b <= 1 and external_id is not null").select("case", F.col("external_id").alias("id"), quote.alias("quote"))
    cases = docs.select("case").distinct().select("case", F.lit("established").alias("class"), F.lit("because").alias("explanation"), (F.col("case") % 3 == 0).alias("suspected"))
    return cases, cited, evidence


def judged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Judgments after their citations are held against the evidence."""
    return agents.validated(*_judgments(spark, d))


def answer_fields(spark: SparkSession, d: str) -> DataFrame:
    """The field of a JSON answer wrapped in prose, per type of event."""
    e = read(spark, d, "events").select("event_type", F.concat(F.lit("Sure: ```json\n"), "props", F.lit("\n``` Done.")).alias("answer"))
    k = F.get_json_object(agents.json_within(F.col("answer")), "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count(k).alias("answers"), F.sum(k).alias("total"))


def claim_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on stale claims that count: known claims, a reason, no contradiction."""
    stale = load(spark, d).edges.filter("status = 'stale'").select("fingerprint").distinct()
    b = dv.bucket(F.col("fingerprint"), 6)
    said = stale.select("fingerprint", F.when(b == 0, "reject").when(b == 1, "maybe").otherwise("confirm").alias("verdict"), F.when(b != 2, "seen").alias("reason"))
    twice = stale.filter(b == 3).select("fingerprint", F.lit("reject").alias("verdict"), F.lit("seen").alias("reason"))
    unknown = stale.filter(b == 4).select(F.concat("fingerprint", F.lit("?")).alias("fingerprint"), F.lit("reject").alias("verdict"), F.lit("seen").alias("reason"))
    return agents.verdicts(stale, said.union(twice).union(unknown))


def grounded_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals on commits cut to what lies in the commit's own neighborhood."""
    graph, own = _parts(spark, d)
    names = nb.changed_names(own, graph).select("kind", "id", "identifier")
    made = names.groupBy("kind", "id").agg(F.array_append(F.array_sort(F.collect_set("identifier")), F.lit("made.up")).alias("symbols"))
    return agents.grounded(made, names).select("kind", "id", F.array_join("symbols", ",").alias("symbols"), "dropped")


QUERIES = {
    f.__name__: f
    for f in (
        neighborhood_links, neighborhood_symbols, neighborhood_knowledge, neighborhood_tests, neighborhood_texts, ticket_units, context_evidence, column_seeds, impact_column, compact_signatures, dashboard_graph, explain_groups,
        condition_weights, code_identifiers, docstring_blocks, judged_cases, answer_fields, claim_verdicts, grounded_proposals,
    )
}

from lodestone.plans.artifact_queries import ORACLE as _ART  # noqa: E402
from lodestone.plans.graph_queries import _KIND, _S, GRAPH  # noqa: E402
from lodestone.plans.text_queries import ORACLE as _TEXT  # noqa: E402

_ARTS = """arts AS (SELECT DISTINCT 'issue' AS kind, issue_key AS id, 'jira' AS provider FROM jira_issues UNION SELECT 'comment', comment_id, 'jira' FROM jira_comments UNION SELECT 'commit', x.commit, 'git' FROM (SELECT unnest(evidence) AS x FROM edges WHERE valid_to IS NULL) WHERE x.commit IS NOT NULL
 UNION SELECT artifact_kind, external_id, 'gitlab' FROM documents WHERE artifact_kind IN ('merge_request','review_comment'))"""
_OWN = f"own AS (SELECT DISTINCT 'commit' AS kind, commit AS id, stable_key AS key FROM ({_ART['changed_symbol_links']}))"
_LINKS = f"""ln AS (SELECT 'comment' AS sk, comment_id AS s, 'comments_on' AS link, 'issue' AS tk, issue_key AS t FROM jira_comments UNION SELECT 'issue', a, 'related_issue', 'issue', b FROM ({_ART['issue_links']})
 UNION SELECT artifact_kind, external_id, 'references', 'issue', issue_key FROM ({_TEXT['reference_links']}) JOIN documents USING (doc_id) WHERE artifact_kind IN ('merge_request','review_comment'))"""
_E2 = "e2 AS (SELECT src, dst, kind, status FROM e UNION SELECT src, dst, kind, status FROM gcl)"
_KNOW = f"""kn0 AS (SELECT DISTINCT own.kind, own.id, e2.dst AS key FROM own JOIN e2 ON e2.src = own.key WHERE e2.status = 'active' AND e2.kind IN ('implements','enforces','satisfies')),
 kn AS (SELECT kn0.kind, kn0.id, row_number() OVER (PARTITION BY kn0.kind, kn0.id ORDER BY identifier, key)::INT AS rank, key, identifier FROM kn0 JOIN n ON n.stable_key = key QUALIFY rank <= 10)"""
_NAMES = "nm AS (SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY identifier)::INT AS rank, identifier FROM (SELECT DISTINCT own.kind, own.id, identifier FROM own JOIN n ON n.stable_key = key) QUALIFY rank <= 30)"
_NEAR = "CASE link WHEN 'comments_on' THEN 1 WHEN 'related_issue' THEN 3 WHEN 'references' THEN 6 END"
_WORDS = "['return','else','then','true','false','error','const','none','some','self','data']"
_TERMS = "['attempt','retry','limit','quota','status','state','permission','role','expired','timeout','amount','price','paid']"
_LOWER = f"translate({{0}}, '{text.UPPER}', '{text.LOWER}')"

ORACLE = {
    "neighborhood_links": f"""WITH {_ARTS}, {_LINKS}, bw AS (SELECT sk AS hk, s AS h, link, tk, t FROM ln UNION SELECT tk, t, link, sk, s FROM ln)
 SELECT hk AS kind, h AS id, row_number() OVER (PARTITION BY hk, h ORDER BY {_NEAR}, provider, tk, t)::INT AS rank, link, tk AS other_kind, t AS other FROM bw JOIN arts ON arts.kind = tk AND arts.id = t WHERE NOT (hk = tk AND h = t) QUALIFY rank <= 20""",
    "neighborhood_symbols": f"{dv.BASE}, {_OWN}, {_NAMES} SELECT * FROM nm",
    "neighborhood_knowledge": f"{dv.BASE}, {_OWN}, {_E2}, {_KNOW} SELECT * FROM kn",
    "neighborhood_tests": f"""{dv.BASE}, {_OWN}, {_E2}, {_KNOW}, ca AS (SELECT src AS a, dst AS b FROM e2 WHERE kind = 'calls' AND status = 'active' UNION SELECT dst, src FROM e2 WHERE kind = 'calls' AND status = 'active'),
 tt AS (SELECT own.kind, own.id, identifier FROM own JOIN ca ON a = own.key JOIN n ON n.stable_key = b AND n.is_test UNION SELECT kn.kind, kn.id, n.identifier FROM kn JOIN e2 ON e2.src = kn.key AND e2.kind = 'covered_by' AND e2.status = 'active' JOIN n ON n.stable_key = e2.dst)
 SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY identifier)::INT AS rank, identifier FROM tt QUALIFY rank <= 15""",
    "context_evidence": f"""WITH {GRAPH}, c AS (SELECT edge_id, trim(any_value(src)) AS src, trim(any_value(dst)) AS dst, {_KIND.format(k='any_value(kind)')} AS kind, any_value(claim_class) AS claim_class, lower(trim(any_value(status))) AS status, any_value(confidence_bp) AS confidence_bp,
 any_value(fingerprint) AS fingerprint, any_value(stale_reason) AS stale_reason, coalesce(any_value(evidence), []) AS ev FROM edges WHERE valid_to IS NULL GROUP BY edge_id)
 SELECT CASE c.kind WHEN 'enforces' THEN 0 WHEN 'implements' THEN 1 WHEN 'covered_by' THEN 2 WHEN 'satisfies' THEN 3 WHEN 'depends_on' THEN 4 ELSE 5 END AS place, fingerprint, a.identifier || ' ' || c.kind || ' ' || b.identifier AS claim, claim_class, c.status, confidence_bp,
 array_to_string(list_transform(ev, lambda x: x.uri || '#' || x.locator), '; ') AS sources, CASE WHEN c.status <> 'active' OR claim_class = 'inference' THEN coalesce(stale_reason, CASE WHEN c.status = 'active' THEN 'inferred relationship' ELSE 'stale relationship' END) END AS doubt
 FROM c JOIN n a ON a.stable_key = c.src JOIN n b ON b.stable_key = c.dst WHERE c.kind IN {_S} OR len(ev) > 0""",
    "column_seeds": f"""WITH {GRAPH}, w AS (SELECT identifier || '.id' AS query FROM n WHERE kind = 'db_entity' UNION SELECT identifier FROM n WHERE kind = 'code_symbol'),
 nm AS (SELECT stable_key, stable_key AS q FROM n UNION SELECT stable_key, identifier FROM n UNION SELECT stable_key, name FROM n), q2 AS (SELECT query, array_to_string(string_split(query, '.')[:-2], '.') AS head, string_split(query, '.')[-1] AS col FROM w),
 ex AS (SELECT q, count(DISTINCT stable_key) AS k, min(stable_key) AS one FROM nm GROUP BY q), lit AS (SELECT query FROM w WHERE query IN (SELECT q FROM nm) OR EXISTS (SELECT 1 FROM n WHERE ends_with(identifier, '.' || query))),
 tb AS (SELECT q2.query, q2.head, q2.col FROM q2 JOIN ex ON ex.q = q2.head AND ex.k = 1 JOIN n ON n.stable_key = ex.one AND n.kind = 'db_entity' WHERE q2.query NOT IN (SELECT query FROM lit) AND contains(q2.query, '.'))
 SELECT w.query, coalesce(tb.head, w.query) AS seed, tb.col AS "column" FROM w LEFT JOIN tb USING (query)""",
    "impact_column": f"""WITH {GRAPH}, ak AS (SELECT stable_key AS dst, unnest(['c0','c1','c2','c3']) AS "column" FROM n WHERE kind = 'db_entity'), lo AS (SELECT src, dst, 'c' || {dv.bucket_sql('src', 3)} AS c FROM e WHERE kind IN ('reads_from','writes_to','defines_schema')),
 h AS (SELECT ak.dst, ak."column", n.identifier FROM ak JOIN lo ON lo.dst = ak.dst AND lo.c = ak."column" JOIN n ON n.stable_key = lo.src), g AS (SELECT dst, "column" FROM ak JOIN lo USING (dst) WHERE lo.c = ak."column" GROUP BY 1, 2)
 SELECT ak.dst, ak."column", coalesce(string_agg(DISTINCT h.identifier, ',' ORDER BY h.identifier), '') AS readers, CASE WHEN max(g.dst) IS NULL THEN 'column ''' || ak."column" || ''' is named by no evidence; the impact of the table is shown' END AS doubt
 FROM ak LEFT JOIN h USING (dst, "column") LEFT JOIN g USING (dst, "column") GROUP BY 1, 2""",
    "compact_signatures": f"WITH {GRAPH} SELECT stable_key, CASE WHEN {dv.bucket_sql('stable_key', 5)} = 4 THEN 'pub fn ' || name || '(a: int):' ELSE '(a: int)' END AS short FROM n WHERE kind = 'code_symbol'",
    "dashboard_graph": f"WITH {GRAPH}, k AS (SELECT stable_key FROM n WHERE kind IN {CATALOG}) SELECT DISTINCT src, dst, kind, status FROM e WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)",
    "explain_groups": f"WITH {GRAPH} SELECT n.kind AS node_kind, a.kind, count(DISTINCT fingerprint) AS claims, count(DISTINCT here) AS nodes FROM around a JOIN n ON n.stable_key = here GROUP BY 1, 2",
    "condition_weights": f"SELECT project_key, CASE WHEN len(list_filter({_TERMS}, lambda t: contains(lower(summary), t))) > 0 THEN 4 ELSE 0 END AS weight, count(*) AS issues FROM (SELECT DISTINCT issue_key, project_key, summary FROM jira_issues) GROUP BY 1, 2",
    "code_identifiers": f"""WITH {GRAPH} SELECT stable_key, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(concat_ws(' ', name, signature), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '[^\\p{{L}}\\p{{N}}]+'),
 lambda w: strlen(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+')), lambda w: {_LOWER.format('w')}), lambda w: NOT list_contains({_WORDS}, w))[1:18])), ',') AS terms FROM n WHERE kind = 'code_symbol'""",
    "docstring_blocks": """WITH b AS (SELECT DISTINCT file_id, regexp_extract_all(text, '(?s)\"\"\"(.*?)\"\"\"', 1) AS x FROM source_files WHERE lower(path) LIKE '%.py' AND text IS NOT NULL)
 SELECT file_id, len(x) AS blocks, list_sum(list_transform(x, lambda s: length(s)))::BIGINT AS chars FROM b WHERE len(x) > 0""",
    "judged_cases": f"""WITH dc AS (SELECT external_id, text, artifact_kind, {dv.bucket_sql('external_id', 200)} AS "case", {dv.bucket_sql("external_id || 'q'", 6)} AS b FROM documents WHERE length(text) > 40),
 ct AS (SELECT DISTINCT "case", external_id AS id, text[5:16] || CASE b WHEN 1 THEN chr(1) ELSE '' END AS quote FROM dc WHERE b <= 1), ok AS (SELECT ct."case", ct.id, dc.artifact_kind, trim(quote) <> '' AND contains(dc.text, quote) AS fine FROM ct LEFT JOIN dc ON dc."case" = ct."case" AND dc.external_id = ct.id),
 s AS (SELECT "case", coalesce(bool_and(fine), true) AS sound, count(*) AS cited, count(DISTINCT CASE WHEN artifact_kind IN ('requirement','decision') THEN id END) AS asserted, min(CASE WHEN artifact_kind IN ('requirement','decision') THEN id END) AS doc,
 bool_or(artifact_kind = 'commit') AS code FROM ok GROUP BY "case"), j AS (SELECT c."case", coalesce(sound, true) AS sound, coalesce(cited, 0) AS cited, coalesce(asserted, 0) AS asserted, doc, c."case" % 3 = 0 AND coalesce(code, false) AND coalesce(asserted, 0) > 0 AS diverges
 FROM (SELECT DISTINCT "case" FROM dc) c LEFT JOIN s USING ("case")), k AS (SELECT *, CASE WHEN NOT sound THEN 'unverified' WHEN diverges THEN 'conflicting' WHEN cited = 0 THEN 'unknown' WHEN asserted = 1 THEN 'established' ELSE 'inferred' END AS class FROM j)
 SELECT "case", class, CASE WHEN class = 'established' THEN doc END AS document, diverges FROM k""",
    "answer_fields": "SELECT event_type, count(json_extract_string(props, '$.k')) AS answers, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1",
    "claim_verdicts": f"""WITH {GRAPH}, s AS (SELECT DISTINCT fingerprint, {dv.bucket_sql('fingerprint', 6)} AS b FROM e WHERE status = 'stale') SELECT fingerprint, CASE WHEN b = 0 THEN 'reject' ELSE 'confirm' END AS verdict, 'seen' AS reason FROM s WHERE b NOT IN (1, 2, 3)""",
    "grounded_proposals": f"{dv.BASE}, {_OWN}, {_NAMES} SELECT kind, id, string_agg(identifier, ',' ORDER BY identifier) AS symbols, 1::BIGINT AS dropped FROM nm GROUP BY 1, 2",
}
