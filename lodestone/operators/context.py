"""Context packs: what of the graph fits a task and a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens, lexical_scores
from lodestone.model import EXPANDING, INTENTS, SEMANTIC, STRUCTURAL, WEAK_BP
from lodestone.operators.graph import both_ways
from lodestone.session import materialise
from lodestone.sources.graph import Graph

BUDGET, SEEDS, HOPS, BOOST = 4000, 5, 3, 150
# Order of the parts of a pack.
PRIORITIES = ["invariant", "requirement", "feature", "decision", "direct_implementation", "data_contract", "test", "adjacent_implementation", "low_confidence"]


def priority(kind: Column, is_test: Column, seed: Column, distance: Column) -> Column:
    near = seed | (distance <= 1)
    name = (
        F.when(kind.isin("invariant", "requirement", "feature", "decision"), kind)
        .when((kind == "code_symbol") & is_test, "test")
        .when(kind.isin("db_entity", "external_system", "endpoint", "api_endpoint", "event"), "data_contract")
        .when(kind.isin("code_symbol", "file") & near, "direct_implementation")
        .when(kind.isin("code_symbol", "file"), "adjacent_implementation")
        .otherwise("low_confidence")
    )
    return F.array_position(F.array(*map(F.lit, PRIORITIES)), name).cast("int")


def content(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn(
        "content",
        F.coalesce(
            F.when(F.col("kind").isin(*INTENTS), F.concat(F.lit("Status: "), F.coalesce("status", F.lit("unknown")), F.lit("\n"), F.coalesce("body", F.lit("")))).when(F.col("kind") == "code_symbol", F.coalesce("signature", F.lit(""))),
            F.lit(""),
        ),
    )


def seeds_of(nodes: DataFrame, scores: DataFrame, count: int = SEEDS) -> DataFrame:
    """The best scored nodes that are no tests; the greater key wins a tie. The limit is the feature."""
    ranked = scores.join(nodes.filter(~F.col("is_test")).select("stable_key"), "stable_key")
    return ranked.orderBy(F.col("score").desc(), F.col("stable_key").desc()).limit(count).select("stable_key")


def expand(graph: Graph, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(stable_key, distance) within ``hops``: one structural step from a seed, semantic ones beyond.

    Rejected claims, weak inferences and second inferences do not lead on; a stale claim shows its
    end and stops. Past the seeds only requirements, invariants, decisions and concepts do.
    """
    edges = both_ways(graph.edges.filter(F.col("status") != "rejected").select("src", "dst", "kind", "status", "claim_class", "confidence_bp")).withColumnRenamed("kind", "relation")
    kinds = graph.nodes.select(F.col("stable_key").alias("here"), "kind", "is_test")
    seen = seeds.select(F.col("stable_key").alias("here"), F.lit(False).alias("inferred"))
    frontier, found = seen, seen.select("here", F.lit(0).alias("distance"))
    for d in range(hops):
        guess = F.col("claim_class") == "inference"
        sound = ~guess | (~F.col("inferred") & (F.col("confidence_bp") >= WEAK_BP))
        lead = F.col("relation").isin(*SEMANTIC) & (F.lit(d == 0) | F.col("kind").isin(*EXPANDING))
        if d == 0:
            lead = lead | F.col("relation").isin(*STRUCTURAL)
        may = F.lit(True) if d == 0 else ~F.col("is_test")
        step = frontier.join(kinds, "here").filter(may).join(edges, "here").filter(sound & lead)
        step = materialise(step.select(F.col("there").alias("here"), (F.col("inferred") | guess).alias("inferred"), (F.col("status") == "stale").alias("stale")).distinct(), f"context-{d}")
        found = found.unionByName(step.select("here", F.lit(d + 1).alias("distance")))
        frontier = step.filter(~F.col("stale")).select("here", "inferred").distinct().join(seen, ["here", "inferred"], "left_anti")
        seen = seen.unionByName(frontier)
    return found.groupBy(F.col("here").alias("stable_key")).agg(F.min("distance").alias("distance"))


def context_pack(graph: Graph, task: list[str], budget: int = BUDGET, task_tokens: int = 1) -> DataFrame:
    """(rank, stable_key, identifier, priority, distance, tokens) of the items a pack takes.

    A fifth of the budget is kept for evidence. In order of priority, score and distance an item
    that fits is taken and one too large is skipped; the first item and invariants are cut to
    what is left. What is still of interest after pruning by size (see ``packing``) is at most
    budget x (2 + ln budget) rows of numbers, which one loop on the driver goes through.
    """
    nodes = content(graph.nodes)
    scores = materialise(lexical_scores(nodes, task, "stable_key", {"name": 4, "identifier": 2, "content": 1}), "scores")
    seeds = materialise(seeds_of(nodes, scores), "seeds")
    wanted = nodes.filter("kind = 'requirement'").join(seeds, "stable_key", "left_semi").select(F.col("stable_key").alias("dst"))
    boost = graph.edges.filter("kind = 'implements' and status = 'active'").join(wanted, "dst", "left_semi").groupBy(F.col("src").alias("stable_key")).agg((F.count(F.lit(1)) * BOOST).alias("boost"))
    reached = expand(graph, seeds).join(nodes, "stable_key").join(scores, "stable_key", "left").join(boost, "stable_key", "left")
    reached = reached.join(seeds.withColumn("seed", F.lit(True)), "stable_key", "left")
    size = estimate_tokens(F.concat_ws(" ", "identifier", "name", "content"))
    items = reached.select(
        "stable_key", "identifier", "kind", "file_path", priority(F.col("kind"), F.col("is_test"), F.coalesce("seed", F.lit(False)), F.col("distance")).alias("p"),
        (F.coalesce("score", F.lit(0)) + F.coalesce("boost", F.lit(0))).alias("score"), "distance", size.alias("tokens"),
    )
    last = (F.col("kind") == "file").cast("int")
    order = [last, F.col("p"), F.col("score").desc(), F.col("distance"), F.col("stable_key")]
    limit = budget - (budget // 5 if budget >= 100 else 0)
    items = materialise(items, "items")
    # both limits are ranks that Spark applies before the shuffle, so no kind or size meets whole
    first = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    cut = items.withColumn("n", first).filter((F.col("n") <= limit) & ((F.col("kind") == "invariant") | (F.col("n") == 1))).drop("n")
    same = F.row_number().over(Window.partitionBy("tokens").orderBy(*order))
    fits = items.withColumn("n", same).filter((F.col("n") <= limit) & (F.col("n") * F.col("tokens") <= limit)).drop("n")
    few = cut.unionByName(fits).distinct()
    used, taken, described, first = min(task_tokens, budget), [], set(), True
    for r in few.orderBy(*order).toLocalIterator():
        if r["kind"] == "file" and r["identifier"] in described:
            continue
        room = limit - used
        if room <= 0:
            break
        tokens = r["tokens"]
        if tokens > room:
            if not (first or r["kind"] == "invariant"):
                continue
            tokens = room
        if r["kind"] == "code_symbol" and r["file_path"]:
            described.add(r["file_path"])
        used, first = used + tokens, False
        taken.append((len(taken) + 1, r["stable_key"], r["identifier"], PRIORITIES[r["p"] - 1], r["distance"], tokens))
    return graph.nodes.sparkSession.createDataFrame(taken, "rank int, stable_key string, identifier string, priority string, distance int, tokens long")
