"""The engine's verbs over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.model import BUCKETS
from lodestone import report
from lodestone.operators import context, diff, graph as g, increments, orphans, repair, scoring, status
from lodestone.plans import artifact_queries, change_queries, graph_queries, neighborhood_queries
from lodestone.session import read, scratch
from lodestone.sources.graph import Graph, load

PARTS = (*dict.fromkeys(BUCKETS.values()), "tests")


class Engine:
    """Questions about one project; every answer is a DataFrame unless it says otherwise."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables = spark, tables
        self._graph: Graph | None = None

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = load(self.spark, self.tables)
        return self._graph

    def find(self, name: str) -> DataFrame:
        """Nodes that a name means, by identifier."""
        wanted = self.spark.createDataFrame([(name,)], "query string")
        found = g.resolve(self.graph.nodes, wanted).join(self.graph.nodes, "stable_key")
        return found.select("identifier", "kind", "symbol_kind", "stable_key").orderBy("identifier", "stable_key")

    def impact(self, target: str) -> DataFrame:
        """Impact of what a target names, one report per identifier; an unknown target raises."""
        seeds = self.find(target).select(F.col("identifier").alias("seed"), F.col("stable_key").alias("key"))
        if seeds.isEmpty():
            raise LookupError(f"nothing is named {target}")
        return g.impact(self.graph, seeds)

    def explain(self, target: str) -> DataFrame:
        """Claims around a target, or between two of them: ``a -> b``."""
        if " -> " in target:
            ends = [self.find(t.strip()).select(F.col("stable_key").alias("key")) for t in target.split(" -> ", 1)]
            return g.relationships(self.graph, *ends)
        return g.claims_of(self.graph).join(self.find(target).select("stable_key"), "stable_key", "left_semi")

    def context(self, task: str, budget: int = context.BUDGET) -> DataFrame:
        """The context pack of a task."""
        if budget <= 0:
            raise ValueError("the budget is empty")
        terms = self.spark.range(1).select(text.terms(F.lit(task)).alias("t")).first()["t"]
        return context.context_pack(self.graph, sorted(terms), budget, max(1, -(-len(task) // 4)))

    def find_requirements(self, query: str, limit: int = 20) -> DataFrame:
        """Intents that share terms with a query, best first; the limit is the feature."""
        words = self.spark.range(1).select(text.words(F.lit(query), 2).alias("t")).first()["t"]
        nodes = self.graph.nodes.filter(F.col("kind").isin("feature", "requirement", "invariant", "decision"))
        score = F.size(F.array_intersect(text.words(F.concat_ws(" ", "identifier", "name", "body"), 2), F.array(*map(F.lit, words)).cast("array<string>")))
        return nodes.select("identifier", "kind", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "identifier").limit(limit)

    def review(self, before: int, after: int) -> DataFrame:
        """Intents behind symbols whose versions changed within (before, after], graded."""
        nodes = read(self.spark, self.tables, "nodes").filter((F.col("created_commit") > before) & (F.col("created_commit") <= after) & (F.col("kind") == "code_symbol"))
        changed = nodes.select(orphans.clean_key(F.col("stable_key")).alias("src")).distinct()
        claims = self.graph.edges.filter("kind in ('implements', 'enforces', 'satisfies') and status <> 'rejected'").join(changed, "src", "left_semi")
        intents = self.graph.nodes.select(F.col("stable_key").alias("dst"), "identifier", F.col("kind").alias("intent_kind"))
        return claims.join(intents, "dst").select("src", "identifier", "intent_kind", diff.severity(F.col("intent_kind")).alias("severity"), "confidence_bp", "status")

    def status(self) -> DataFrame:
        """Counts of current nodes and claims."""
        return graph_queries.status_counts(self.spark, self.tables)

    def freshness(self) -> DataFrame:
        return change_queries.freshness(self.spark, self.tables)

    def pending(self, root: str | None = None) -> DataFrame:
        """Tracker comments the next run takes up; ``root`` keeps the consumer's offsets between runs."""
        root = root or scratch(self.spark, "pending")
        capture = increments.ChangeCapture(self.spark, root)
        sink = increments.KeyOffsetSink(self.spark, f"{root}/sink", increments.VERSION_SCHEMA, "comment_id", "fetch_id")
        return increments.pending_comments(capture, sink, *(read(self.spark, self.tables, t) for t in ("jira_comments", "analyzed_inputs", "enrich_runs")))

    def trace(self, route: str) -> DataFrame:
        """What an endpoint (``METHOD /path``) leads to: its handler, what that touches and calls."""
        graph = self.graph
        ends = graph.nodes.filter((F.col("kind") == "api_endpoint") & (F.col("stable_key") == F.concat(F.lit("api_endpoint:"), F.replace(F.lit(route), F.lit(" "), F.lit(":"))))).select("stable_key")
        least = graph.edges.filter("kind = 'exposes'").join(ends, F.col("dst") == F.col("stable_key"), "left_semi").groupBy("dst").agg(F.min(F.struct("src", "status")).alias("h"))
        handlers = least.filter("h.status = 'active'").select(F.col("dst").alias("endpoint"), F.col("h.src").alias("src"))
        out = graph.edges.filter("status = 'active' and kind in ('reads_from', 'writes_to', 'calls_external', 'calls')").join(handlers, "src")
        return out.select("endpoint", F.col("src").alias("handler"), "kind", F.col("dst").alias("target")).distinct()

    def coverage(self) -> DataFrame:
        """Share of analysed symbols that a claim maps, by kind of symbol."""
        return graph_queries.coverage_share(self.spark, self.tables)

    def gaps(self) -> DataFrame:
        """Intents that expect an implementation and have none."""
        return graph_queries.unmapped_intents(self.spark, self.tables)

    def verify(self, verdicts: DataFrame, at: int) -> DataFrame:
        """Claims and the rows that verdicts (fingerprint, verdict) add; nothing is overwritten."""
        columns = ["fingerprint", "src", "dst", "kind", "claim_class", "source_kind", "confidence_bp", "status", "producer", "valid_from"]
        return repair.recorded(self.graph.edges.select(*columns), verdicts, at)

    def repairs(self) -> DataFrame:
        """Anchors of documents whose symbol is gone, by what may be done about them."""
        nodes = read(self.spark, self.tables, "nodes")
        symbols = lambda n: n.filter("kind = 'code_symbol'").select(F.col("identifier").alias("name"), F.col("stable_key").alias("key"), F.col("content_hash").alias("shape"))
        return repair.drift(repair.document_links(nodes), symbols(self.graph.nodes), symbols(nodes.filter("retired_commit is not null")))

    def neighbors(self, since: str) -> DataFrame:
        """What each neighbouring repository offers and whether it changed since an instant."""
        return status.neighbor_states(read(self.spark, self.tables, "endpoints"), since)

    def health(self) -> DataFrame:
        """Health of each repository's index and the first notice about it."""
        intents = self.graph.nodes.filter("kind in ('feature', 'requirement', 'invariant', 'decision')")
        return status.health(self.freshness(), graph_queries.stale_claims(self.spark, self.tables), self.gaps(), intents)

    def neighborhood(self, kind: str, id: str) -> DataFrame:
        """What is linked to one artifact, strongest first."""
        rows = neighborhood_queries.neighborhood_links(self.spark, self.tables)
        return rows.filter((F.col("kind") == kind) & (F.col("id") == id)).orderBy("rank")

    def report(self, folder: str) -> None:
        """Write the report as a static site."""
        report.write_site(report.datasets(self.spark, self.tables), folder)

    def candidates(self, keep: int | None = None) -> DataFrame:
        """Links between code and intents worth a review."""
        return scoring.link_candidates(self.graph, keep if keep is not None else scoring.KEEP)

    def prune(self) -> DataFrame:
        """Artifacts by whether they stay in scope, and why."""
        return artifact_queries.scope_plan(self.spark, self.tables)
