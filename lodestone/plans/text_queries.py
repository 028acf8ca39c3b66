"""Queries on text, search, packing and similarity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import ddl, text
from lodestone.model import INTENTS
from lodestone.operators import packing, similarity
from lodestone.session import read
from lodestone.sources.graph import load

TASK = ["invoice", "refund", "policy", "validate", "snapshot", "ledger"]


def doc_references(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.inline(text.references(F.col("text"))))
    return docs.distinct()


def reference_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents linked to the known issues whose keys they name."""
    keys = read(spark, d, "jira_issues").select("issue_key").distinct()
    refs = doc_references(spark, d).filter("kind = 'ticket_key'").select("doc_id", F.col("value").alias("issue_key"))
    return refs.join(keys, "issue_key", "left_semi").select("doc_id", "issue_key")


def issue_references(spark: SparkSession, d: str) -> DataFrame:
    """References in issue summaries and descriptions by kind, without those to the issue itself."""
    issues = read(spark, d, "jira_issues").select("issue_id", "issue_key", "summary", "description").distinct()
    both = issues.select("issue_id", "issue_key", F.explode(F.array("summary", "description")).alias("t"))
    refs = both.select("issue_id", "issue_key", F.inline(text.references(F.col("t")))).filter("value <> issue_key").distinct()
    return refs.select("issue_id", "kind", "value")


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How many current nodes have each term in name or identifier."""
    nodes = load(spark, d).nodes
    found = nodes.select("stable_key", F.explode(F.array_union(text.terms(F.col("name")), text.terms(F.col("identifier")))).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))
    return docs.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def node_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical scores of all current nodes for a task."""
    nodes = load(spark, d).nodes.withColumn("content", F.when(F.col("kind").isin(*INTENTS), F.col("body")).when(F.col("kind") == "code_symbol", F.col("signature")))
    return text.lexical_scores(nodes, TASK, "stable_key", {"name": 4, "identifier": 2, "content": 1})


def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical scores of all documents for a task."""
    return text.lexical_scores(read(spark, d, "documents"), TASK, "doc_id", {"external_id": 4, "source": 2, "text": 1})


def find_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Intents by how many of the task's terms they hold."""
    nodes = load(spark, d).nodes.filter(F.col("kind").isin(*INTENTS))
    found = text.words(F.concat_ws(" ", "identifier", "name", "body"), 2)
    score = F.size(F.array_intersect(found, F.array(*map(F.lit, TASK))))
    return nodes.select("stable_key", score.alias("score")).filter("score > 0")


def path_templates(spark: SparkSession, d: str) -> DataFrame:
    calls = read(spark, d, "external_calls").select("call_id", "url").distinct()
    return calls.select("call_id", text.path_template(F.col("url")).alias("template"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").filter("text is not null")
    return docs.groupBy("source").agg(F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("docs"))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """For each source the documents that a pack of 4000 tokens takes, newest first."""
    docs = read(spark, d, "documents").filter("text is not null").select("source", "doc_id", text.estimate_tokens(F.col("text")).alias("tokens"), "updated_at")
    return packing.pack(docs, "source", "tokens", [F.col("updated_at").desc_nulls_last(), F.col("doc_id")], "doc_id")


def derived_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("text is not null").select("doc_id", text.derived_title(F.col("text")).alias("title"))


def comment_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Comment candidates of a file whose lines touch, merged into blocks."""
    rows = read(spark, d, "code_docs").filter("kind = 'comment'").select("file_id", "start_line", "end_line").distinct()
    order = Window.partitionBy("file_id").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = rows.withColumn("fresh", fresh).withColumn("island", island)
    return blocks.groupBy("file_id", "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("comments")).drop("island")


def symbol_parts(spark: SparkSession, d: str) -> DataFrame:
    """Language, path, kind and owner of every symbol, from its key; its signature without its name."""
    nodes = load(spark, d).nodes.filter("kind = 'code_symbol'")
    inner = F.regexp_extract("stable_key", r"^symbol:[^:]+:(.*):[^:]+$", 1)
    shape = F.regexp_replace(F.replace("signature", "name", F.lit("#")), r"\s+", "")
    return nodes.select(
        "stable_key", F.split("stable_key", ":")[1].alias("language"), inner.alias("path"), F.regexp_extract("stable_key", r":([^:]+)$", 1).alias("symbol"),
        F.regexp_extract("identifier", r"^(.*)\.[^.]*$", 1).alias("owner"), shape.alias("shape"),
    )


def endpoint_keys(spark: SparkSession, d: str) -> DataFrame:
    """Method and path of every endpoint node, from its key."""
    nodes = load(spark, d).nodes.filter("kind = 'api_endpoint'")
    return nodes.select("stable_key", F.regexp_extract("stable_key", r"^api_endpoint:([A-Z]+):(.*)$", 1).alias("method"), F.regexp_extract("stable_key", r"^api_endpoint:([A-Z]+):(.*)$", 2).alias("path"))


def call_keys(spark: SparkSession, d: str) -> DataFrame:
    """Calls per method whose key is the one their method and url make."""
    made = F.concat_ws(":", F.lit("external_http"), "method", "url")
    return read(spark, d, "external_calls").distinct().groupBy("method").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.trim("stable_key") == made).alias("same"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Dotted module of every Python file, without source roots and package markers."""
    files = read(spark, d, "source_files").filter(F.lower("path").endswith(".py")).select("path").distinct()
    bare = F.regexp_replace(F.regexp_replace("path", r"(?i)\.py$", ""), r"^src/|/__init__$", "")
    return files.select("path", F.replace(bare, F.lit("/"), F.lit(".")).alias("module"))


def ddl_tables(spark: SparkSession, d: str) -> DataFrame:
    """Statements of SQL files: entity, operation, column and type."""
    files = read(spark, d, "source_files").filter(F.lower("path").endswith(".sql") & F.col("text").isNotNull()).select("file_id", "text").distinct()
    return ddl.operations(files, "file_id", "text").select("file_id", "entity", "op", "column", "data_type")


def _intents(spark: SparkSession, d: str) -> DataFrame:
    nodes = load(spark, d).nodes.filter(F.col("kind").isin(*INTENTS))
    return nodes.select("stable_key", "kind", text.requirement_terms(F.concat_ws(" ", "identifier", "name", "body")).alias("t"))


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Intents of a kind that share three fifths of their terms, as pairs of classes."""
    return similarity.overlap_pairs(_intents(spark, d), "stable_key", "kind", "t")


def intent_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.clusters(_intents(spark, d), "stable_key", "kind", "t")


def corpus_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters per kind and language, with totals."""
    docs = read(spark, d, "documents").select("artifact_kind", F.lower("lang").alias("lang"), "n_chars")
    out = docs.rollup("artifact_kind", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))
    return out


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and key of their JSON properties."""
    rows = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_references, reference_links, issue_references, term_frequencies, word_frequencies, node_search, tfidf_search, find_requirements, path_templates, token_estimates,
        token_budget, derived_titles, comment_blocks, symbol_parts, endpoint_keys, call_keys, modules, ddl_tables, overlap_pairs, intent_clusters, corpus_rollup, event_props,
    )
}

from lodestone.plans.graph_queries import GRAPH  # noqa: E402

_LOWER = f"translate({{0}}, '{text.UPPER}', '{text.LOWER}')"


def _words(x: str, least: int) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= {least}), lambda w: {_LOWER.format('w')}))"


def _terms(x: str) -> str:
    split = f"regexp_replace({x}, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1 \\2', 'g')"
    low = _LOWER.format("w")
    stem = f"CASE WHEN {low} = 'dedupe' THEN 'dedup' WHEN ends_with({low}, 's') AND NOT ends_with({low}, 'ss') AND strlen({low}) > 3 THEN {low}[:-2] ELSE {low} END"
    return f"list_distinct(list_transform(list_filter(regexp_split_to_array({split}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 3), lambda w: {stem}))"


def _refs(table: str, key: str, x: str) -> str:
    """References of a text; neighbours are doubled so that each key keeps its own boundaries."""
    double = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g')"
    part = lambda kind, pattern, fix="v": f"SELECT {key}, '{kind}' AS kind, {fix} AS value FROM (SELECT {key}, unnest(regexp_extract_all({double}, '{pattern}', 1)) AS v FROM {table})"
    urls = f"SELECT {key}, 'url' AS kind, regexp_replace(v, '[.,:;]+$', '') AS value FROM (SELECT {key}, unnest(regexp_extract_all({x}, 'https?://[^\\s)\\]}}>\"'']+')) AS v FROM {table})"
    return " UNION ".join([
        part("ticket_key", r"(?:^|[^\p{L}\p{N}])([A-Z]{2,10}--[0-9]{1,6})(?:[^0-9A-Za-z]|$)", "replace(v, '--', '-')"),
        part("issue_number", r"(?:^|[^\p{L}\p{N}])#([0-9]+)(?:[^0-9A-Za-z]|$)"),
        part("merge_request_number", r"(?:^|[^\p{L}\p{N}])!([0-9]+)(?:[^0-9A-Za-z]|$)"), urls,
    ])


def _scores(table: str, key: str, cols: dict[str, int]) -> str:
    task = ", ".join(f"('{t}')" for t in TASK)
    weight = " ".join(f"WHEN list_contains({_terms(f'coalesce({c}, chr(32))')}, term) THEN {w}" for c, w in cols.items())
    return f"""hits AS (SELECT {key}, term, CASE {weight} END AS weight FROM {table}, (VALUES {task}) AS t(term)),
 h AS (SELECT * FROM hits WHERE weight IS NOT NULL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term), tot AS (SELECT count(*) AS total FROM {table})
 SELECT {key}, sum(weight * (greatest(floor(log2(total + 1))::INT - floor(log2(df))::INT, 0) + 1) * 25)::BIGINT AS score FROM h JOIN df USING (term), tot GROUP BY {key}"""


_INTENT = "('feature','requirement','invariant','decision')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_IT = f"""it AS (SELECT stable_key, kind, list_sort(list_filter({_words("concat_ws(' ', identifier, name, body)", 3)}, lambda w: NOT list_contains({_STOPS}, w))) AS t FROM n WHERE kind IN {_INTENT}),
 cl AS (SELECT kind, t, min(stable_key) AS rep FROM it WHERE len(t) > 0 GROUP BY kind, t),
 pr AS (SELECT x.kind, x.rep AS a, y.rep AS b FROM cl x JOIN cl y ON x.kind = y.kind AND x.rep < y.rep WHERE len(list_intersect(x.t, y.t)) * 5 >= least(len(x.t), len(y.t)) * 3)"""

ORACLE = {
    "doc_references": _refs("documents", "doc_id", "text"),
    "reference_links": f"WITH r AS ({_refs('documents', 'doc_id', 'text')}) SELECT DISTINCT doc_id, value AS issue_key FROM r WHERE kind = 'ticket_key' AND value IN (SELECT issue_key FROM jira_issues)",
    "issue_references": f"""WITH i AS (SELECT issue_id, issue_key, summary AS t FROM jira_issues UNION ALL SELECT issue_id, issue_key, description FROM jira_issues), j AS (SELECT * FROM i WHERE t IS NOT NULL), r AS ({_refs('j', 'issue_id, issue_key', 't')})
 SELECT DISTINCT issue_id, kind, value FROM r WHERE value <> issue_key""",
    "term_frequencies": f"WITH {GRAPH}, f AS (SELECT stable_key, unnest(list_distinct(list_concat({_terms('name')}, {_terms('identifier')}))) AS term FROM n) SELECT term, count(*) AS df FROM f GROUP BY term",
    "word_frequencies": f"SELECT word, count(*) AS df FROM (SELECT unnest({_words('text', 3)}) AS word FROM documents) GROUP BY word",
    "node_search": f"WITH {GRAPH}, m AS (SELECT *, CASE WHEN kind IN {_INTENT} THEN body WHEN kind = 'code_symbol' THEN signature END AS content FROM n), {_scores('m', 'stable_key', {'name': 4, 'identifier': 2, 'content': 1})}",
    "tfidf_search": f"WITH {_scores('documents', 'doc_id', {'external_id': 4, 'source': 2, 'text': 1})}",
    "find_requirements": f"""WITH {GRAPH}, s AS (SELECT stable_key, len(list_intersect({_words("concat_ws(' ', identifier, name, body)", 2)}, {TASK})) AS score FROM n WHERE kind IN {_INTENT}) SELECT * FROM s WHERE score > 0""",
    "path_templates": r"""SELECT call_id, CASE WHEN url ~ '^[A-Za-z][A-Za-z0-9+.-]*://.*' AND p = '' THEN '/' WHEN starts_with(p, '/') THEN p END AS template FROM (SELECT DISTINCT call_id, url,
 regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/\{[^/]*\}', '/{param}', 'g') AS p FROM external_calls)""",
    "token_estimates": "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY source",
    "token_budget": """WITH RECURSIVE o AS (SELECT source, doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC NULLS LAST, doc_id) AS k
 FROM documents WHERE length(text) BETWEEN 1 AND 16000), walk AS (SELECT source, 0::BIGINT AS k, NULL::BIGINT AS doc_id, 0::BIGINT AS tokens, false AS taken, 4000::BIGINT AS room FROM (SELECT DISTINCT source FROM o)
 UNION ALL SELECT o.source, o.k, o.doc_id, o.tokens, o.tokens <= w.room, w.room - CASE WHEN o.tokens <= w.room THEN o.tokens ELSE 0 END FROM walk w JOIN o ON o.source = w.source AND o.k = w.k + 1)
 SELECT source, doc_id, tokens FROM walk WHERE taken""",
    "derived_titles": r"""WITH l AS (SELECT doc_id, trim(string_split(trim(text, ' '), chr(10))[1], ' ') AS line FROM documents WHERE text IS NOT NULL),
 t AS (SELECT doc_id, CASE WHEN regexp_extract(line, '^(.*?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(line, '^(.*?[.!?])(?:\s|$)', 1) ELSE line END AS title FROM l)
 SELECT doc_id, CASE WHEN length(title) > 80 THEN title[:80] || '…' ELSE title END AS title FROM t""",
    "comment_blocks": """WITH r AS (SELECT DISTINCT file_id, start_line, end_line FROM code_docs WHERE kind = 'comment'),
 m AS (SELECT *, max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_line, end_line) AS island FROM m)
 SELECT file_id, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS comments FROM i GROUP BY file_id, island""",
    "symbol_parts": f"""WITH {GRAPH} SELECT stable_key, string_split(stable_key, ':')[2] AS language, regexp_extract(stable_key, '^symbol:[^:]+:(.*):[^:]+$', 1) AS path, regexp_extract(stable_key, ':([^:]+)$', 1) AS symbol,
 regexp_extract(identifier, '^(.*)\\.[^.]*$', 1) AS owner, regexp_replace(replace(signature, name, '#'), '\\s+', '', 'g') AS shape FROM n WHERE kind = 'code_symbol'""",
    "endpoint_keys": f"WITH {GRAPH} SELECT stable_key, regexp_extract(stable_key, '^api_endpoint:([A-Z]+):(.*)$', 1) AS method, regexp_extract(stable_key, '^api_endpoint:([A-Z]+):(.*)$', 2) AS path FROM n WHERE kind = 'api_endpoint'",
    "call_keys": "SELECT method, count(*) AS calls, count(*) FILTER (trim(stable_key) = 'external_http:' || method || ':' || url) AS same FROM (SELECT DISTINCT * FROM external_calls) GROUP BY method",
    "modules": "SELECT DISTINCT path, replace(regexp_replace(regexp_replace(path, '(?i)\\.py$', ''), '^src/|/__init__$', '', 'g'), '/', '.') AS module FROM source_files WHERE lower(path) LIKE '%.py'",
    "overlap_pairs": f"WITH {GRAPH}, {_IT} SELECT kind, a, b FROM pr",
    "intent_clusters": f"""WITH {GRAPH}, {_IT}, walk AS (SELECT rep AS key, rep AS root FROM cl UNION SELECT w.key, CASE WHEN p.a = w.root THEN p.b ELSE p.a END FROM walk w JOIN pr p ON w.root IN (p.a, p.b)),
 ro AS (SELECT key, min(root) AS root FROM walk GROUP BY key) SELECT stable_key, root AS cluster FROM it JOIN cl USING (kind, t) JOIN ro ON ro.key = cl.rep""",
    "corpus_rollup": "SELECT artifact_kind, lower(lang) AS lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars, grouping_id(artifact_kind, lower(lang))::INT AS level FROM documents GROUP BY ROLLUP (artifact_kind, lower(lang))",
    "event_props": "SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "ddl_tables": r"""SELECT DISTINCT file_id, lower(regexp_extract(text, '(?i)create table (\w+)', 1)) AS entity, unnest(['create', 'add']) AS op, unnest([NULL, regexp_extract(text, '\((\w+) \w+\)', 1)]) AS "column",
 unnest([NULL, regexp_extract(text, '\(\w+ (\w+)\)', 1)]) AS data_type FROM source_files WHERE lower(path) LIKE '%.sql' AND text ~ '(?is).*create table.*'""",
}
