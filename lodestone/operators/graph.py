"""Traversals of the claim graph as unrolled or iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.model import EXPANDING, HOPS, SEMANTIC, STRUCTURAL, WEAK_BP, bucket
from lodestone.operators.skew import HOT_FLOOR, hot_keys, salted_join
from lodestone.session import materialise, observed, together
from lodestone.sources.graph import Graph

ROUNDS = 200


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges as seen from either end: (here, there, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    forth = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), *rest)
    back = edges.filter(F.col("src") != F.col("dst")).select(F.col("dst").alias("here"), F.col("src").alias("there"), *rest)
    return forth.unionByName(back)


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, stable_key) by two tiers: exact key, identifier or name, else a dotted suffix.

    ``wanted`` has a column query. Equi-joins only: the suffix tier joins on each suffix of the
    identifier that follows a dot. Queries without any match have no row.
    """
    names = nodes.select("stable_key", F.explode(F.array_distinct(F.array_compact(F.array("stable_key", "identifier", "name")))).alias("query"))
    exact = wanted.join(names, "query").select("query", "stable_key").distinct()
    parts = F.split("identifier", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffixes = nodes.filter(F.contains("identifier", F.lit("."))).select("stable_key", F.explode(F.array_distinct(tails)).alias("query")).filter(F.col("query") != "")
    rest = wanted.join(exact.select("query"), "query", "left_anti").join(suffixes, "query").select("query", "stable_key").distinct()
    return exact.unionByName(rest)


def structural_hop(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, key) of the seeds and what one active structural edge links to them."""
    around = both_ways(graph.edges.filter((F.col("status") == "active") & F.col("kind").isin(*STRUCTURAL)).select("src", "dst"))
    hop = seeds.join(around.withColumnRenamed("here", "key"), "key").select("seed", F.col("there").alias("key"))
    return seeds.select("seed", "key").unionByName(hop).distinct()


def semantic_reach(graph: Graph, roots: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(seed, key) met on up to ``hops`` semantic edges from the roots, which are written first.

    Rejected claims are invisible; a stale one shows its end and stops there; an inference counts
    at 0.65 and more, and never follows another. Tests do not bridge unless they are the seed;
    past the roots only requirements, invariants, decisions and concepts lead on.
    """
    edges = both_ways(
        graph.edges.filter(F.col("kind").isin(*SEMANTIC) & (F.col("status") != "rejected")).select("src", "dst", "status", "claim_class", "confidence_bp")
    ).withColumnRenamed("here", "key")
    kinds = graph.nodes.select(F.col("stable_key").alias("key"), F.col("kind").isin(*EXPANDING).alias("leads"), "is_test")
    guess, stale = F.col("claim_class") == "inference", F.col("status") == "stale"
    # what a hop asks of a claim and of the node it starts from, joined once for all hops
    sound = edges.filter(stale | ~guess | (F.col("confidence_bp") >= WEAK_BP)).join(kinds, "key")
    sound = sound.select("key", "there", guess.alias("guess"), stale.alias("stale"), "leads", "is_test")
    (sound, heavy), roots = together(lambda: observed(sound, "claims", rows=F.count(F.lit(1))), lambda: materialise(roots, "roots"))
    hot = hot_keys(sound.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n") if heavy["rows"] >= HOT_FLOOR else []
    seen = roots.withColumn("inferred", F.lit(False))
    frontier = seen.join(seeds.select("seed", "key", F.lit(True).alias("is_seed")), ["seed", "key"], "left")
    reached = roots
    for depth in range(hops):
        may = ~F.col("is_test") & F.col("leads") if depth else ~F.col("is_test") | F.coalesce("is_seed", F.lit(False))
        step = salted_join(sound, frontier, "key", F.col("there"), hot, "inner")
        step = step.filter(may & (F.col("stale") | ~F.col("guess") | ~F.col("inferred")))
        step = step.select("seed", F.col("there").alias("key"), (F.col("inferred") | F.col("guess")).alias("inferred"), "stale").distinct()
        if depth + 1 == hops:
            reached = reached.unionByName(step.select("seed", "key"))
            break
        step = materialise(step, f"step-{depth}")
        reached = reached.unionByName(step.select("seed", "key"))
        frontier = step.filter("not stale").select("seed", "key", "inferred").join(seen, ["seed", "key", "inferred"], "left_anti")
        seen = seen.unionByName(frontier)
        frontier = frontier.withColumn("is_seed", F.lit(False))
    return reached.distinct()


def uncertainties(graph: Graph) -> DataFrame:
    """Semantic claims a traversal reports as uncertain, with the reason."""
    sem = graph.edges.filter(F.col("kind").isin(*SEMANTIC) & (F.col("status") != "rejected"))
    text = F.concat_ws(" ", "src", "kind", "dst").alias("claim")
    reason = F.when(F.col("status") == "stale", F.coalesce("stale_reason", F.lit("stale relationship"))).when(
        F.col("claim_class") == "inference", F.coalesce("stale_reason", F.lit("inferred relationship"))
    )
    return sem.select("fingerprint", text, reason.alias("reason")).filter(F.col("reason").isNotNull()).distinct()


def settled(graph: Graph) -> Graph:
    """The graph's traversal columns, derived once and read back by every hop."""
    nodes = graph.nodes.select("stable_key", "identifier", "kind", "is_test")
    edges = graph.edges.select("src", "dst", "kind", "status", "claim_class", "confidence_bp")
    return Graph(*together(lambda: materialise(nodes, "nodes"), lambda: materialise(edges, "edges")))


def impact(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Impact of every seed at once: (seed, bucket, stable_key, identifier).

    ``seeds``: (seed, key); one seed may stand for several keys. One structural hop, then three
    semantic ones, then each node into its part of the report. Keys without a node are left out.
    """
    graph = settled(graph)
    seeds = seeds.select("seed", "key")
    reached = semantic_reach(graph, structural_hop(graph, seeds), seeds)
    nodes = graph.nodes.select("stable_key", "identifier", bucket(F.col("kind"), F.col("is_test")).alias("bucket"))
    return (
        reached.withColumnRenamed("key", "stable_key").join(nodes, "stable_key").filter(F.col("bucket").isNotNull())
        .select("seed", "bucket", "stable_key", "identifier").distinct()
    )


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(key, depth): least number of edges from any seed over (src, dst), either way.

    A driver loop of frontier joins; each round is written to the shared folder, so the plan
    stays flat and a lost executor costs one round. Raises if ROUNDS are not enough.
    """
    around, size = observed(both_ways(edges.select("src", "dst")).select(F.col("here").alias("key"), "there").distinct(), "around", rows=F.count(F.lit(1)))
    hot = hot_keys(around.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n") if size["rows"] >= HOT_FLOOR else []
    frontier = materialise(seeds.select("key").distinct().withColumn("depth", F.lit(0)), "depth-0")
    found = frontier
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = salted_join(around, frontier.select("key"), "key", F.col("there"), hot, "inner").select(F.col("there").alias("key")).distinct()
        frontier, new = observed(step.join(found.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)), f"depth-{depth}", rows=F.count(F.lit(1)))
        if not new["rows"]:
            break
        if depth > ROUNDS:
            raise RuntimeError(f"nodes lie more than {ROUNDS} edges from every seed")
        found = found.unionByName(frontier)
    return found


def related_tests(graph: Graph, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Tests that active structural edges connect to any seed, with their distance."""
    edges = graph.edges.filter((F.col("status") == "active") & F.col("kind").isin(*STRUCTURAL))
    tests = graph.nodes.filter("is_test").select(F.col("stable_key").alias("key"), "identifier")
    return distances(edges, seeds, max_depth).filter("depth > 0").join(tests, "key").select(F.col("key").alias("stable_key"), "identifier", "depth")


def callers(graph: Graph) -> DataFrame:
    """(callee, caller) over active calls."""
    return graph.edges.filter((F.col("kind") == "calls") & (F.col("status") == "active")).select(F.col("dst").alias("callee"), F.col("src").alias("caller")).distinct()


def call_reach(graph: Graph, levels: int, starts: DataFrame | None = None) -> DataFrame:
    """(key, other, depth): symbols reached over active calls within ``levels`` calls, least depth.

    Only from ``starts`` (key), where given. Each level is written and holds no pair of an earlier
    one, so cycles are not walked again.
    """
    calls = materialise(callers(graph).select(F.col("caller").alias("a"), F.col("callee").alias("b")), "calls")
    level = calls.select(F.col("a").alias("key"), F.col("b").alias("other"))
    if starts is not None:
        level = level.join(starts.select("key").distinct(), "key", "left_semi")
    level = out = level.withColumn("depth", F.lit(1))
    for d in range(2, levels + 1):
        step = level.join(calls, level["other"] == calls["a"]).select("key", F.col("b").alias("other")).distinct()
        level = materialise(step.join(out.select("key", "other"), ["key", "other"], "left_anti").withColumn("depth", F.lit(d)), f"reach-{d}")
        out = out.unionByName(level)
    return out


def claims_of(graph: Graph) -> DataFrame:
    """Every claim from the point of view of each node it touches."""
    around = both_ways(graph.edges).withColumn("claim", F.concat_ws(" ", "here", "kind", "there"))
    nodes = graph.nodes.select(F.col("stable_key").alias("here"), "identifier")
    return around.join(nodes, "here").select("identifier", F.col("here").alias("stable_key"), F.col("there").alias("other"), "kind", "claim_class", "status", "confidence_bp", "fingerprint")


def relationships(graph: Graph, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims from any of the source keys to any of the target keys."""
    return graph.edges.join(sources.select(F.col("key").alias("src")), "src", "left_semi").join(targets.select(F.col("key").alias("dst")), "dst", "left_semi")


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(key, root): connected components by least key, over undirected pairs.

    Alternates large-star and small-star contractions: the number of rounds grows with the
    logarithm of the diameter. Every round is one job, written to the shared folder, and whether it
    changed anything is seen while it is written. Hubs are dealt out over salts. Raises if ROUNDS are not
    enough.
    """
    sums = {"rows": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, before = observed(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v").distinct(), "star-0", **sums)
    for n in range(ROUNDS):
        around = edges.select("u", "v").union(edges.select("v", "u"))
        large = _contracted(around, F.least(F.min("v"), F.col("u")), before["rows"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()  # both uses below share its one exchange
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _contracted(down, F.min("v"), before["rows"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges, after = observed(small.filter("u <> v").distinct(), f"star-{n + 1}", **sums)
        if before == after:
            break
        before = after
    else:
        raise RuntimeError(f"{ROUNDS} rounds left components unmerged")
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.union(edges.select("v", "v")).groupBy("key").agg(F.min("root").alias("root"))


def _contracted(edges: DataFrame, least, rows: int) -> DataFrame:
    """(u, v, m): each edge with the least key around its ``u``."""
    low = edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(low, "u", "n") if rows >= HOT_FLOOR else []
    return salted_join(edges, low.select("u", "m"), "u", F.col("v"), hot, "inner")
