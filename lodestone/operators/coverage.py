"""Where code decides something, and whether anyone wrote down why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import call_reach, callers
from lodestone.sources.graph import Graph

# Weight of what a symbol does, and the caps of the signals.
WRITE, READ, EXTERNAL = 5, 2, 5
LEVELS, CAP, ENTRY_LEVELS, ENTRY_CAP = 3, 8, 4, 3


def effects(graph: Graph) -> DataFrame:
    """(key, effects): weighted sum of what each symbol's active claims touch."""
    weight = F.when(F.col("kind") == "writes_to", WRITE).when(F.col("kind") == "reads_from", READ).when(F.col("kind") == "calls_external", EXTERNAL)
    touched = graph.edges.filter("status = 'active' and kind in ('writes_to', 'reads_from', 'calls_external')").select("src", "dst", "kind").distinct()
    return touched.groupBy(F.col("src").alias("key")).agg(F.sum(weight).alias("effects"))


def downstream(graph: Graph) -> DataFrame:
    """(key, weight) of what each symbol's calls lead to within three calls, at most 8.

    A callee counts 1 plus its effects divided by its distance (whole numbers). Stopping after the
    level that reaches the cap gives the same, because no weight is negative.
    """
    reach = call_reach(graph, LEVELS).filter("key <> other")
    weighted = reach.join(effects(graph).withColumnRenamed("key", "other"), "other", "left")
    each = 1 + F.floor(F.coalesce("effects", F.lit(0)) / F.col("depth"))
    return weighted.groupBy("key").agg(F.least(F.lit(CAP), F.sum(each)).cast("long").alias("weight"))


def entry_reach(graph: Graph) -> DataFrame:
    """(key, entries): exposing symbols that lead to each symbol within four calls, at most 3."""
    entries = graph.edges.filter("kind = 'exposes' and status = 'active'").select(F.col("src").alias("key")).distinct()
    reach = call_reach(graph, ENTRY_LEVELS, entries).filter("key <> other")
    return reach.groupBy(F.col("other").alias("key")).agg(F.least(F.lit(ENTRY_CAP), F.countDistinct("key")).alias("entries"))


def decision_scores(graph: Graph, points: DataFrame) -> DataFrame:
    """Points (anchor, key, condition, direct, imbalance, sdk, shaped, routine) with their score.

    Signals add up under their caps: condition, direct effects (12), imbalance of the branches
    (4), downstream calls (8), entry reach (3), SDK calls (2 x 3), a mapped intent and the shape
    (1 each). A point asks a question if it is no routine, scores 4 and some strong signal backs it.
    """
    mapped = graph.edges.filter("status = 'active' and claim_class = 'assertion'").select(F.col("src").alias("key"), F.lit(1).alias("mapped")).distinct()
    j = points.join(downstream(graph), "key", "left").join(entry_reach(graph), "key", "left").join(mapped, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    direct, sdk = F.least(zero("direct"), F.lit(12)), F.least(zero("sdk"), F.lit(2)) * 3
    score = zero("condition") + direct + F.least(zero("imbalance"), F.lit(4)) + zero("weight") + zero("entries") + sdk + zero("mapped") + F.coalesce(F.col("shaped").cast("int"), F.lit(0))
    strong = (zero("condition") > 0) | (direct > 0) | (sdk > 0) | (zero("entries") > 0)
    return j.select("anchor", "key", score.cast("long").alias("score"), (~F.coalesce("routine", F.lit(False)) & (score >= 4) & strong).alias("asks"))


def gap_states(scores: DataFrame, records: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, state): explained, ambiguous, reopened, the recorded state, or open.

    ``records``: (anchor, state, revision_hash, current_hash); ``anchors``: (anchor, document).
    """
    documents = anchors.distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("documents"))
    j = scores.filter("asks").select("anchor").join(documents, "anchor", "left").join(records, "anchor", "left")
    state = (
        F.when(F.col("documents") == 1, "explained").when(F.col("documents") > 1, "ambiguous")
        .when(F.col("state").isNotNull() & ~F.col("revision_hash").eqNullSafe(F.col("current_hash")), "reopened")
        .otherwise(F.coalesce("state", F.lit("open")))
    )
    return j.select("anchor", state.alias("state"))


def hubs(graph: Graph) -> DataFrame:
    """(key, callers, callees) of every symbol that calls or is called."""
    calls = callers(graph)
    called = calls.groupBy(F.col("callee").alias("key")).agg(F.count(F.lit(1)).alias("callers"))
    calling = calls.groupBy(F.col("caller").alias("key")).agg(F.count(F.lit(1)).alias("callees"))
    return called.join(calling, "key", "full_outer").select("key", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))
