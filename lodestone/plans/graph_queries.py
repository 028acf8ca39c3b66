"""Queries over the current graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import INTENTS, LIVE_STATUS, SEMANTIC, state
from lodestone.operators import graph as g
from lodestone.session import read
from lodestone.sources import export
from lodestone.sources.graph import duplicate_keys, load


def current_nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.select("stable_key", "kind", "name", "identifier", "created_commit")


def current_edges(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).edges.select("src", "dst", "kind", "claim_class", "status", "confidence_bp", "fingerprint", "valid_from")


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows of open edges, exploded, with the least strength of each edge (0.8 without any)."""
    edges = read(spark, d, "edges").filter(F.col("valid_to").isNull()).select("edge_id", "evidence").dropDuplicates(["edge_id"])
    least = F.coalesce(F.array_min(F.transform("evidence", lambda e: e.strength)), F.lit(0.8))
    return edges.select("edge_id", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("sources"), least.alias("confidence"))


def _seeds(graph, kind: str) -> DataFrame:
    return graph.nodes.filter(F.col("kind") == kind).select(F.col("stable_key").alias("seed"), F.col("stable_key").alias("key"))


def impact(spark: SparkSession, d: str) -> DataFrame:
    """Impact reports of every decision and invariant of the graph at once."""
    graph = load(spark, d)
    seeds = _seeds(graph, "invariant").unionByName(_seeds(graph, "decision"))
    return g.impact(graph, seeds)


def impact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Size of each part of the impact report of every API endpoint."""
    graph = load(spark, d)
    return g.impact(graph, _seeds(graph, "api_endpoint")).groupBy("seed", "bucket").agg(F.count(F.lit(1)).alias("n"))


def impact_uncertainties(spark: SparkSession, d: str) -> DataFrame:
    return g.uncertainties(load(spark, d))


def resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Handlers and the last two parts of all identifiers, resolved to nodes by exact match or dotted suffix."""
    graph = load(spark, d)
    named = read(spark, d, "external_calls").select(F.col("handler").alias("query")).union(read(spark, d, "endpoints").select("handler"))
    parts = F.split("identifier", r"\.")
    tails = read(spark, d, "nodes").select(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("query"))
    return g.resolve(graph.nodes, named.union(tails).filter("query <> ''").distinct())


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests within three structural edges of any event, with their distance."""
    graph = load(spark, d)
    return g.related_tests(graph, _seeds(graph, "event"), 3)


def min_depth(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every reachable node from the domain concepts, over all open edges, at any depth."""
    graph = load(spark, d)
    return g.distances(graph.edges, _seeds(graph, "domain_concept"))


def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return g.callers(load(spark, d)).groupBy("callee").agg(F.countDistinct("caller").alias("callers"))


def reachable_entries(spark: SparkSession, d: str) -> DataFrame:
    """How many exposing symbols reach each symbol within four calls, at most 3 counted."""
    graph = load(spark, d)
    entries = graph.edges.filter((F.col("kind") == "exposes") & (F.col("status") == "active")).select(F.col("src").alias("key")).distinct()
    reach = g.call_reach(graph, 4, entries).filter(F.col("key") != F.col("other"))
    return reach.groupBy("other").agg(F.least(F.lit(3), F.countDistinct("key")).alias("entries"))


def explain_claims(spark: SparkSession, d: str) -> DataFrame:
    return g.claims_of(load(spark, d)).select("identifier", "stable_key", "other", "kind", "claim_class", "status", "confidence_bp", "fingerprint")


def explain_relationship(spark: SparkSession, d: str) -> DataFrame:
    """Claims from any code symbol to any database entity."""
    graph = load(spark, d)
    symbols = graph.nodes.filter("kind = 'code_symbol'").select(F.col("stable_key").alias("key"))
    tables = graph.nodes.filter("kind = 'db_entity'").select(F.col("stable_key").alias("key"))
    return g.relationships(graph, symbols, tables).select("src", "dst", "kind", "status", "fingerprint").distinct()


def edge_endpoints_outside(spark: SparkSession, d: str) -> DataFrame:
    """Open claims by kind, and how many have an end that is no current node."""
    graph = load(spark, d)
    keys = graph.nodes.select("stable_key")
    src = graph.edges.join(keys.select(F.col("stable_key").alias("src"), F.lit(True).alias("s")), "src", "left")
    both = src.join(keys.select(F.col("stable_key").alias("dst"), F.lit(True).alias("t")), "dst", "left")
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("dangling"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """The status row: conditional counts over current nodes and claims in one pass each."""
    graph = load(spark, d)
    k = F.col("kind")
    nodes = graph.nodes.agg(
        F.count_if(k == "file").alias("files"), F.count_if(k == "code_symbol").alias("symbols"), F.count_if(F.col("is_test")).alias("tests"),
        F.count_if(k == "requirement").alias("requirements"), F.count_if(k == "invariant").alias("invariants"), F.count_if(k == "decision").alias("decisions"),
        F.count_if(k == "feature").alias("features"), F.count_if(k == "db_entity").alias("db_entities"), F.count_if(k == "api_endpoint").alias("api_endpoints"),
        F.count_if(k.isin(*INTENTS) & (F.col("visibility") == "public")).alias("public_documents"),
    )
    edges = graph.edges.agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "stale").alias("stale_claims"), F.count_if(F.col("status") == "rejected").alias("rejected_claims"),
        F.count_if((F.col("claim_class") == "fact") & (F.col("status") == "active")).alias("active_facts"),
        F.count_if((F.col("claim_class") == "inference") & (F.col("status") == "active")).alias("active_inferences"),
    )
    return nodes.join(edges)  # one row each


def unmapped_intents(spark: SparkSession, d: str) -> DataFrame:
    """Requirements, invariants and decisions that expect an implementation and have none."""
    graph = load(spark, d)
    wanted = graph.nodes.filter(F.col("kind").isin("requirement", "invariant", "decision") & F.coalesce("implementation_expected", F.lit(True)))
    mapped = graph.edges.filter(F.col("kind").isin("implements", "enforces", "satisfies") & (F.col("status") == "active")).select(F.col("dst").alias("stable_key"))
    return wanted.join(mapped, "stable_key", "left_anti").select("stable_key", "identifier", "kind")


def active_intents(spark: SparkSession, d: str) -> DataFrame:
    graph = load(spark, d)
    return graph.nodes.filter(F.col("kind").isin(*INTENTS) & state(F.col("status")).isin(*LIVE_STATUS)).select("stable_key", "identifier", "kind")


def stale_claims(spark: SparkSession, d: str) -> DataFrame:
    """Stale semantic claims with their text and reason."""
    graph = load(spark, d)
    stale = graph.edges.filter(F.col("kind").isin(*SEMANTIC) & (F.col("status") == "stale"))
    text = F.concat(F.col("src"), F.lit(" -> "), F.col("dst")).alias("claim")
    return stale.select("fingerprint", text, F.coalesce("stale_reason", F.lit("stale relationship")).alias("reason")).distinct()


def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    """Open claims that are no facts and touch a symbol whose body changed in its last version.

    A symbol changed if its key has versions with different content hashes.
    """
    graph = load(spark, d)
    versions = read(spark, d, "nodes").filter("kind = 'code_symbol'").select(F.trim("stable_key").alias("key"), "content_hash")
    changed = versions.groupBy("key").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).filter("a <> b").select("key")
    claims = graph.edges.filter("claim_class <> 'fact'").select("src", "dst", "fingerprint")
    ends = claims.select("fingerprint", F.col("src").alias("key")).union(claims.select("fingerprint", "dst"))
    return ends.join(changed, "key", "left_semi").select("fingerprint", F.lit("implementation_changed").alias("reason")).distinct()


def structural_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the number of intents that active assertions tie them to."""
    edges = load(spark, d).edges.filter("status = 'active' and claim_class = 'assertion'")
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("intents"))


def coverage_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of analysed symbols that a claim maps, by kind of symbol; null without symbols."""
    graph = load(spark, d)
    mapped = graph.edges.filter(F.col("kind").isin(*SEMANTIC) & (F.col("status") == "active")).select(F.col("src").alias("stable_key"), F.lit(1).alias("m")).distinct()
    symbols = graph.nodes.filter("kind = 'code_symbol'").join(mapped, "stable_key", "left")
    n, m = F.count(F.lit(1)), F.count("m")
    return symbols.groupBy("symbol_kind").agg(n.alias("analyzed"), m.alias("mapped"), F.try_divide(m * F.lit(100.0), n).alias("percent"))


def unique_symbol_names(spark: SparkSession, d: str) -> DataFrame:
    """Callable names that belong to exactly one symbol of a language."""
    symbols = load(spark, d).nodes.filter("kind = 'code_symbol'").withColumn("language", F.split("stable_key", ":")[1])
    return symbols.groupBy("language", "name").agg(F.count(F.lit(1)).alias("n"), F.min("stable_key").alias("stable_key")).filter("n = 1").select("language", "name", "stable_key")


def symbol_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals of versions that share one key, and the commit that closes each but the last."""
    nodes = read(spark, d, "nodes").select(F.trim("stable_key").alias("stable_key"), "created_commit", "content_hash").distinct()
    return duplicate_keys(nodes)


def same_file_renames(spark: SparkSession, d: str) -> DataFrame:
    """Removed and added symbols of one file and kind with equal content, where the match is unique both ways."""
    nodes = read(spark, d, "nodes").filter("kind = 'code_symbol' and file_path is not null").select(
        F.trim("stable_key").alias("k"), "file_path", "symbol_kind", "content_hash", "retired_commit"
    ).distinct()
    gone = nodes.filter("retired_commit is not null").select(F.col("k").alias("old_key"), "file_path", "symbol_kind", "content_hash").distinct()
    here = nodes.filter("retired_commit is null").select(F.col("k").alias("new_key"), "file_path", "symbol_kind", "content_hash").distinct()
    return renamed(gone, here)


def renamed(gone: DataFrame, here: DataFrame) -> DataFrame:
    """Pairs of a removed and an added symbol that alone share file, kind and content on either side."""
    on = ["file_path", "symbol_kind", "content_hash"]
    olds = gone.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("old_key").alias("old_key")).filter("n = 1").drop("n")
    news = here.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("new_key").alias("new_key")).filter("n = 1").drop("n")
    return olds.join(news, on).filter("old_key <> new_key").select("file_path", "old_key", "new_key")


def prefix_nesting(spark: SparkSession, d: str) -> DataFrame:
    """The longest dotted prefix of each symbol's identifier that is a symbol of the same file."""
    symbols = load(spark, d).nodes.filter("kind = 'code_symbol'").select(
        "stable_key", "file_path", F.regexp_replace("identifier", "::", ".").alias("path")
    )
    return nested(symbols)


def nested(symbols: DataFrame) -> DataFrame:
    """(stable_key, parent): the longest dotted prefix of a path that is one symbol of the file."""
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    children = symbols.filter(F.size(parts) > 1).select("stable_key", "file_path", F.explode(prefixes).alias("prefix"))
    parents = symbols.groupBy("file_path", F.col("path").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("stable_key").alias("parent")).filter("n = 1")
    found = children.join(parents, ["file_path", "prefix"])
    return found.groupBy("stable_key").agg(F.max_by("parent", F.length("prefix")).alias("parent"))


def handlers(spark: SparkSession, d: str) -> DataFrame:
    """The handler of each endpoint: its least exposing source, null unless that claim is active."""
    edges = load(spark, d).edges.filter("kind = 'exposes'")
    least = edges.groupBy("dst").agg(F.min(F.struct("src", "status")).alias("h"))
    return least.select(F.col("dst").alias("endpoint"), F.when(F.col("h.status") == "active", F.col("h.src")).alias("handler"))


def access_sets(spark: SparkSession, d: str) -> DataFrame:
    """What each symbol reads and writes: sorted distinct targets of active claims."""
    edges = load(spark, d).edges.filter("status = 'active' and kind in ('reads_from', 'writes_to')")
    return edges.groupBy("src", "kind").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"), F.countDistinct("dst").alias("n"))


def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """Indexed files and the sweep threshold: a tenth of them, at least 20."""
    files = load(spark, d).nodes.filter("kind = 'code_symbol'").agg(F.countDistinct("file_path").alias("files"))
    return files.select("files", F.greatest(F.lit(20), F.round(F.col("files") * 0.1)).cast("long").alias("threshold"))


def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """Every directory of the indexed files with the files and symbols below it."""
    nodes = load(spark, d).nodes.filter("file_path is not null").select("stable_key", "file_path")
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    below = nodes.filter(F.size(parts) > 1).select("stable_key", "file_path", F.explode(dirs).alias("directory"))
    return below.groupBy("directory").agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def catalogs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("identifier").alias("first"), F.max("identifier").alias("last"))


def diagrams(spark: SparkSession, d: str) -> DataFrame:
    """A diagram of the first forty claims around each node."""
    return export.mermaid(load(spark, d))


def public_documents(spark: SparkSession, d: str) -> DataFrame:
    return export.public_documents(load(spark, d)).select("identifier", "kind", "name", "status")


def offered_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The endpoints of the manifest: what each repository offers, by its newest contract."""
    return export.offered_endpoints(read(spark, d, "endpoints")).select("source_repo", "method", "path", "handler", "framework")


QUERIES = {
    f.__name__: f
    for f in (
        current_nodes, current_edges, edge_evidence, impact, impact_counts, impact_uncertainties, resolve_tiers, related_tests, min_depth, callers_of,
        reachable_entries, explain_claims, explain_relationship, edge_endpoints_outside, status_counts, unmapped_intents, active_intents, stale_claims,
        stale_marks, structural_mappings, coverage_share, unique_symbol_names, symbol_collisions, same_file_renames, prefix_nesting, handlers, access_sets,
        indexed_files, directory_tree, catalogs, diagrams, public_documents, offered_endpoints,
    )
}

_KIND = """CASE lower(replace(replace({k}, '_', ''), ' ', '')) WHEN 'dependson' THEN 'depends_on' WHEN 'readsfrom' THEN 'reads_from' WHEN 'writesto' THEN 'writes_to'
 WHEN 'definesschema' THEN 'defines_schema' WHEN 'coveredby' THEN 'covered_by' WHEN 'callsexternal' THEN 'calls_external' ELSE lower(replace(replace({k}, '_', ''), ' ', '')) END"""

GRAPH = rf"""
RECURSIVE n AS (
  SELECT * EXCLUDE (stable_key), trim(stable_key) AS stable_key, coalesce(symbol_kind = 'test', false) AS is_test FROM nodes
  WHERE retired_commit IS NULL AND trim(stable_key) <> ''
  QUALIFY row_number() OVER (PARTITION BY trim(stable_key) ORDER BY created_commit DESC, recorded_at DESC, content_hash DESC) = 1
), claims AS (
  SELECT * FROM edge_snapshots WHERE commit_seq = (SELECT max(commit_seq) FROM index_snapshots WHERE is_complete)
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY recorded_at DESC) = 1
), e AS (
  SELECT src, dst, kind, claim_class, source_kind, confidence_bp, status, fingerprint, producer, stale_reason, valid_from FROM (
    SELECT DISTINCT edge_id, trim(src) AS src, trim(dst) AS dst, {_KIND.format(k='kind')} AS kind, claim_class, source_kind, confidence_bp,
           lower(trim(status)) AS status, fingerprint, producer, stale_reason, valid_from
    FROM edges WHERE valid_to IS NULL AND trim(src) <> '' AND trim(dst) <> '')
  UNION ALL
  SELECT src, dst, {_KIND.format(k='kind')}, claim_class, source_kind, confidence_bp, coalesce(lower(trim(status)), 'active'), fingerprint, producer, stale_reason, commit_seq FROM claims
), around AS (
  SELECT src AS here, dst AS there, * EXCLUDE (src, dst) FROM e UNION ALL SELECT dst, src, * EXCLUDE (src, dst) FROM e WHERE src <> dst
)"""
_S = "('implements','enforces','covered_by','depends_on','satisfies')"
_T = "('contains','calls','references','reads_from','writes_to','defines_schema','exposes','calls_external','emits','handles')"
_CALLS = "calls AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE kind = 'calls' AND status = 'active')"


def _impact(seed: str) -> str:
    step = """SELECT DISTINCT f.seed, s.there AS key, (f.inferred OR s.claim_class = 'inference') AS inferred, s.status = 'stale' AS stale
  FROM {f} f JOIN n ON n.stable_key = f.key JOIN sem s ON s.here = f.key
  WHERE {may} AND (s.status = 'stale' OR s.claim_class <> 'inference' OR (NOT f.inferred AND s.confidence_bp >= 6500))"""
    later = "NOT n.is_test AND n.kind IN ('requirement','invariant','decision','domain_concept')"
    return f"""
, seeds AS (SELECT stable_key AS seed FROM n WHERE {seed}),
sem AS (SELECT * FROM around WHERE kind IN {_S} AND status <> 'rejected'),
roots AS (SELECT seed, seed AS key FROM seeds UNION SELECT seed, there FROM seeds JOIN around ON here = seed WHERE status = 'active' AND kind IN {_T}),
f0 AS (SELECT seed, key, false AS inferred FROM roots),
s1 AS ({step.format(f='f0', may='(NOT n.is_test OR f.key = f.seed)')}),
f1 AS (SELECT seed, key, inferred FROM s1 WHERE NOT stale EXCEPT SELECT * FROM f0),
s2 AS ({step.format(f='f1', may=later)}),
f2 AS (SELECT seed, key, inferred FROM s2 WHERE NOT stale EXCEPT (SELECT * FROM f0 UNION SELECT * FROM f1)),
s3 AS ({step.format(f='f2', may=later)}),
reached AS (SELECT * FROM roots UNION SELECT seed, key FROM s1 UNION SELECT seed, key FROM s2 UNION SELECT seed, key FROM s3),
report AS (SELECT DISTINCT seed, CASE WHEN kind = 'feature' THEN 'features' WHEN kind = 'requirement' THEN 'requirements' WHEN kind = 'invariant' THEN 'invariants'
  WHEN kind = 'decision' THEN 'decisions' WHEN kind IN ('db_entity','external_system','endpoint','event') THEN 'data_contracts' WHEN kind = 'api_endpoint' THEN 'api_contracts'
  WHEN kind = 'code_symbol' AND is_test THEN 'tests' WHEN kind IN ('code_symbol','file') THEN 'implementation' END AS bucket, stable_key, identifier
  FROM reached JOIN n ON n.stable_key = reached.key)"""


def _bfs(seed: str, where: str, depth: int) -> str:
    return f"""
, walk AS (SELECT stable_key AS key, 0 AS depth FROM n WHERE {seed}
  UNION SELECT there, depth + 1 FROM walk JOIN around ON here = key WHERE depth < {depth} AND {where}),
dist AS (SELECT key, min(depth) AS depth FROM walk GROUP BY key)"""


_BODY = {
    "current_nodes": "SELECT stable_key, kind, name, identifier, created_commit FROM n",
    "current_edges": "SELECT src, dst, kind, claim_class, status, confidence_bp, fingerprint, valid_from FROM e",
    "impact": _impact("kind IN ('invariant', 'decision')") + " SELECT seed, bucket, stable_key, identifier FROM report WHERE bucket IS NOT NULL",
    "impact_counts": _impact("kind = 'api_endpoint'") + " SELECT seed, bucket, count(*) AS n FROM report WHERE bucket IS NOT NULL GROUP BY ALL",
    "impact_uncertainties": f"""SELECT DISTINCT fingerprint, src || ' ' || kind || ' ' || dst AS claim,
 CASE WHEN status = 'stale' THEN coalesce(stale_reason, 'stale relationship') ELSE coalesce(stale_reason, 'inferred relationship') END AS reason
 FROM e WHERE kind IN {_S} AND status <> 'rejected' AND (status = 'stale' OR claim_class = 'inference')""",
    "resolve_tiers": """, w AS (SELECT handler AS query FROM external_calls UNION SELECT handler FROM endpoints UNION SELECT array_to_string(string_split(identifier, '.')[-2:], '.') FROM nodes WHERE identifier <> ''),
 names AS (SELECT stable_key, stable_key AS query FROM n UNION SELECT stable_key, identifier FROM n UNION SELECT stable_key, name FROM n),
 exact AS (SELECT DISTINCT query, stable_key FROM w JOIN names USING (query)),
 rest AS (SELECT * FROM w WHERE query NOT IN (SELECT query FROM exact))
 SELECT * FROM exact UNION ALL SELECT DISTINCT query, stable_key FROM rest JOIN n ON ends_with(identifier, '.' || query)""",
    "related_tests": _bfs("kind = 'event'", f"status = 'active' AND kind IN {_T}", 3) + " SELECT stable_key, identifier, depth FROM dist JOIN n ON stable_key = key WHERE depth > 0 AND is_test",
    "min_depth": """, dist(key, depth) USING KEY (key) AS (SELECT stable_key, 0 FROM n WHERE kind = 'domain_concept'
 UNION SELECT there, min(d.depth) + 1 FROM dist d JOIN around ON here = d.key LEFT JOIN recurring.dist r ON r.key = there WHERE r.key IS NULL GROUP BY there) SELECT key, depth FROM dist""",
    "callers_of": f", {_CALLS} SELECT b AS callee, count(DISTINCT a) AS callers FROM calls GROUP BY b",
    "reachable_entries": f""", {_CALLS}, r1 AS (SELECT a, b FROM calls), r2 AS (SELECT DISTINCT r1.a, c.b FROM r1 JOIN calls c ON r1.b = c.a),
 r3 AS (SELECT DISTINCT r2.a, c.b FROM r2 JOIN calls c ON r2.b = c.a), r4 AS (SELECT DISTINCT r3.a, c.b FROM r3 JOIN calls c ON r3.b = c.a),
 r AS (SELECT * FROM r1 UNION SELECT * FROM r2 UNION SELECT * FROM r3 UNION SELECT * FROM r4)
 SELECT b AS other, least(3, count(DISTINCT a)) AS entries FROM r WHERE a <> b AND a IN (SELECT src FROM e WHERE kind = 'exposes' AND status = 'active') GROUP BY b""",
    "explain_claims": "SELECT identifier, here AS stable_key, there AS other, a.kind, claim_class, a.status, confidence_bp, fingerprint FROM around a JOIN n ON n.stable_key = here",
    "explain_relationship": """SELECT DISTINCT src, dst, kind, status, fingerprint FROM e WHERE src IN (SELECT stable_key FROM n WHERE kind = 'code_symbol')
 AND dst IN (SELECT stable_key FROM n WHERE kind = 'db_entity')""",
    "edge_endpoints_outside": """SELECT e.kind, count(*) AS claims, count(*) FILTER (a.stable_key IS NULL OR b.stable_key IS NULL) AS dangling
 FROM e LEFT JOIN n a ON a.stable_key = src LEFT JOIN n b ON b.stable_key = dst GROUP BY e.kind""",
    "status_counts": """SELECT * FROM (SELECT count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'code_symbol') AS symbols, count(*) FILTER (is_test) AS tests,
 count(*) FILTER (kind = 'requirement') AS requirements, count(*) FILTER (kind = 'invariant') AS invariants, count(*) FILTER (kind = 'decision') AS decisions,
 count(*) FILTER (kind = 'feature') AS features, count(*) FILTER (kind = 'db_entity') AS db_entities, count(*) FILTER (kind = 'api_endpoint') AS api_endpoints,
 count(*) FILTER (kind IN ('feature','requirement','invariant','decision') AND visibility = 'public') AS public_documents FROM n),
 (SELECT count(*) AS claims, count(*) FILTER (status = 'stale') AS stale_claims, count(*) FILTER (status = 'rejected') AS rejected_claims,
 count(*) FILTER (claim_class = 'fact' AND status = 'active') AS active_facts, count(*) FILTER (claim_class = 'inference' AND status = 'active') AS active_inferences FROM e)""",
    "unmapped_intents": """SELECT stable_key, identifier, kind FROM n WHERE kind IN ('requirement','invariant','decision') AND coalesce(implementation_expected, true)
 AND stable_key NOT IN (SELECT dst FROM e WHERE kind IN ('implements','enforces','satisfies') AND status = 'active')""",
    "active_intents": "SELECT stable_key, identifier, kind FROM n WHERE kind IN ('feature','requirement','invariant','decision') AND lower(trim(status)) IN ('active','accepted','approved')",
    "stale_claims": f"SELECT DISTINCT fingerprint, src || ' -> ' || dst AS claim, coalesce(stale_reason, 'stale relationship') AS reason FROM e WHERE kind IN {_S} AND status = 'stale'",
    "stale_marks": """, changed AS (SELECT trim(stable_key) AS key FROM nodes WHERE kind = 'code_symbol' GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)
 SELECT DISTINCT fingerprint, 'implementation_changed' AS reason FROM e WHERE claim_class <> 'fact' AND (src IN (SELECT key FROM changed) OR dst IN (SELECT key FROM changed))""",
    "structural_mappings": "SELECT src, count(DISTINCT dst) AS intents FROM e WHERE status = 'active' AND claim_class = 'assertion' GROUP BY src",
    "coverage_share": f""", m AS (SELECT DISTINCT src FROM e WHERE kind IN {_S} AND status = 'active')
 SELECT symbol_kind, count(*) AS analyzed, count(src) AS mapped, count(src) * 100.0::DOUBLE / count(*) AS percent FROM n LEFT JOIN m ON src = stable_key WHERE kind = 'code_symbol' GROUP BY symbol_kind""",
    "unique_symbol_names": """SELECT string_split(stable_key, ':')[2] AS language, name, min(stable_key) AS stable_key FROM n WHERE kind = 'code_symbol' GROUP BY 1, 2 HAVING count(*) = 1""",
    "symbol_collisions": """, v AS (SELECT DISTINCT trim(stable_key) AS stable_key, created_commit, content_hash FROM nodes)
 SELECT stable_key, created_commit, content_hash, lead(created_commit) OVER (PARTITION BY stable_key ORDER BY created_commit, content_hash) AS closes_at FROM v""",
    "same_file_renames": """, v AS (SELECT DISTINCT trim(stable_key) AS k, file_path, symbol_kind, content_hash, retired_commit IS NULL AS here FROM nodes WHERE kind = 'code_symbol' AND file_path IS NOT NULL),
 o AS (SELECT file_path, symbol_kind, content_hash, min(k) AS old_key FROM v WHERE NOT here GROUP BY 1, 2, 3 HAVING count(*) = 1),
 w AS (SELECT file_path, symbol_kind, content_hash, min(k) AS new_key FROM v WHERE here GROUP BY 1, 2, 3 HAVING count(*) = 1)
 SELECT file_path, old_key, new_key FROM o JOIN w USING (file_path, symbol_kind, content_hash) WHERE old_key <> new_key""",
    "prefix_nesting": """, s AS (SELECT stable_key, file_path, replace(identifier, '::', '.') AS path FROM n WHERE kind = 'code_symbol'),
 p AS (SELECT file_path, path, min(stable_key) AS parent FROM s GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT s.stable_key, arg_max(parent, length(p.path)) AS parent FROM s JOIN p ON p.file_path = s.file_path AND starts_with(s.path, p.path || '.') GROUP BY s.stable_key""",
    "handlers": """SELECT dst AS endpoint, CASE WHEN status = 'active' THEN src END AS handler FROM e WHERE kind = 'exposes'
 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, status) = 1""",
    "access_sets": """SELECT src, kind, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets, count(DISTINCT dst) AS n FROM e WHERE status = 'active' AND kind IN ('reads_from','writes_to') GROUP BY src, kind""",
    "indexed_files": "SELECT count(DISTINCT file_path) AS files, greatest(20, round(count(DISTINCT file_path) * 0.1))::BIGINT AS threshold FROM n WHERE kind = 'code_symbol'",
    "directory_tree": """, d AS (SELECT stable_key, file_path, unnest(list_transform(range(1, len(string_split(file_path, '/'))), lambda i: array_to_string(string_split(file_path, '/')[1:i], '/'))) AS directory
 FROM n WHERE file_path IS NOT NULL) SELECT directory, count(DISTINCT file_path) AS files, count(*) AS symbols FROM d GROUP BY directory""",
    "diagrams": """, r AS (SELECT *, row_number() OVER (PARTITION BY here ORDER BY kind, there, fingerprint) AS k FROM around QUALIFY k <= 40)
 SELECT here AS stable_key, 'graph LR' || chr(10) || string_agg('  a["' || replace(here, '"', '#quot;') || '"] -->|' || kind || '| n' || k || '["' || replace(there, '"', '#quot;') || '"]', chr(10) ORDER BY k) AS diagram FROM r GROUP BY here""",
    "public_documents": "SELECT identifier, kind, name, status FROM n WHERE kind IN ('feature','requirement','invariant','decision') AND visibility = 'public'",
    "catalogs": "SELECT kind, count(*) AS n, min(identifier) AS first, max(identifier) AS last FROM n GROUP BY kind",
}
ORACLE = {name: f"WITH {GRAPH} {body}" for name, body in _BODY.items()} | {
    "offered_endpoints": """SELECT source_repo, method, path, handler, framework FROM endpoints WHERE withdrawn_at IS NULL
 QUALIFY row_number() OVER (PARTITION BY source_repo, method, path ORDER BY published_at DESC, handler DESC) = 1""",
    "edge_evidence": """SELECT edge_id, coalesce(len(any_value(evidence)), 0) AS sources, coalesce(list_min(list_transform(any_value(evidence), lambda x: x.strength)), 0.8) AS confidence
 FROM edges WHERE valid_to IS NULL GROUP BY edge_id"""
}
