"""Scores of links between code and intents, in basis points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import requirement_terms
from lodestone.model import INTENTS
from lodestone.operators.graph import both_ways
from lodestone.session import materialise
from lodestone.sources.graph import Graph

# Weights of the signals and the threshold, in basis points.
LEXICAL, STRUCTURAL, TEST, DATA, ARTIFACT = 3500, 3000, 1500, 1000, 1000
KEEP = 6500


def link_candidates(graph: Graph, keep: int = KEEP, evidence: DataFrame | None = None) -> DataFrame:
    """(symbol, intent, relation, lexical, structural, test, data, artifact, score) of links worth a review.

    ``evidence``: (intent, symbol) of symbols that an artifact behind the intent changed. Words, tests
    and data reach at most 6000, so at higher thresholds only symbols that are call neighbours of
    code tied to the intent, share its file or are in the evidence can qualify. At lower ones pairs
    that a test ties together are candidates too, and pairs that share as many terms as the
    threshold asks for beside the data signal: these meet by the rarest terms of both sides, never
    as all pairs. Existing links are left out.
    """
    nodes = materialise(graph.nodes.select("stable_key", "kind", "identifier", "name", "body", "signature", "file_path", "is_test"), "score-nodes")
    edges = materialise(graph.edges.select("src", "dst", "kind", "claim_class", "status"), "score-edges")
    intents = nodes.filter(F.col("kind").isin(*INTENTS)).select(F.col("stable_key").alias("intent"), F.col("kind").alias("intent_kind"), requirement_terms(F.concat_ws(" ", "identifier", "name", "body")).alias("ti"))
    symbols = nodes.filter((F.col("kind") == "code_symbol") & ~F.col("is_test")).select(
        F.col("stable_key").alias("symbol"), "file_path", requirement_terms(F.concat_ws(" ", "identifier", "name", "signature")).alias("ts")
    )
    verified = (
        edges.filter((F.col("claim_class") == "assertion") & (F.col("status") == "active") & F.col("kind").isin("implements", "enforces", "satisfies", "depends_on"))
        .select(F.col("src").alias("known"), F.col("dst").alias("intent")).distinct()
    )
    calls = both_ways(edges.filter("kind = 'calls'").select("src", "dst", "status")).select("here", "there", "status").distinct()
    near = verified.join(calls.filter("status = 'active'"), F.col("known") == F.col("here")).select("intent", F.col("there").alias("symbol"), F.lit(10).alias("s"))
    files = verified.join(nodes.select(F.col("stable_key").alias("known"), "file_path"), "known").filter("file_path is not null").select("intent", "file_path").distinct()
    beside = files.join(symbols.select("symbol", "file_path"), "file_path").select("intent", "symbol", F.lit(6).alias("s"))
    backed = near.filter(F.lit(False)).select("intent", "symbol") if evidence is None else evidence.select("intent", "symbol")
    signals = near.unionByName(beside).withColumn("f", F.lit(0)).unionByName(backed.select("intent", "symbol", F.lit(0).alias("s"), F.lit(10).alias("f")))
    tests = nodes.filter("is_test").select(F.col("stable_key").alias("there"))
    covered = edges.filter("kind = 'covered_by'").select(F.col("src").alias("intent"), F.col("dst").alias("there")).join(tests, "there", "left_semi")
    tested = covered.join(calls.select("here", "there").distinct(), "there").select("intent", F.col("here").alias("symbol"), F.lit(10).alias("t")).distinct()
    access = edges.filter("kind in ('reads_from', 'writes_to') and status = 'active'").select("src", "dst", "kind").distinct()
    touched = verified.join(access, F.col("known") == F.col("src")).select("intent", "dst", "kind").distinct()
    mine = access.select(F.col("src").alias("symbol"), "dst", F.col("kind").alias("k"))
    if keep <= LEXICAL + TEST + DATA:
        need = -(-(keep - DATA) // (LEXICAL // 4))
        more = [tested.select("intent", "symbol")]
        if need < 1:
            more.append(touched.join(mine, "dst").select("intent", "symbol"))
        if need <= 4:
            more.append(sharing(intents.select("intent", F.col("ti").alias("t")), symbols.select("symbol", F.col("ts").alias("t")), max(1, need)))
        for pairs in more:
            signals = signals.unionByName(pairs.select("intent", "symbol", F.lit(0).alias("s"), F.lit(0).alias("f")))
    structural = signals.groupBy("intent", "symbol").agg(F.max("s").alias("s"), F.max("f").alias("f"))
    linked = edges.select(F.col("src").alias("symbol"), F.col("dst").alias("intent")).distinct()
    base = structural.join(linked, ["symbol", "intent"], "left_anti").join(symbols, "symbol").join(intents, "intent")
    data = base.select("intent", "symbol").join(touched, "intent").join(mine, ["symbol", "dst"]).groupBy("intent", "symbol").agg(F.max(F.when(F.col("k") == F.col("kind"), 10).otherwise(6)).alias("d"))
    scored = base.join(tested, ["intent", "symbol"], "left").join(data, ["intent", "symbol"], "left")
    lexical = F.least(F.size(F.array_intersect("ts", "ti")), F.lit(4)) * (LEXICAL // 4)
    out = scored.select(
        "symbol", "intent", F.when(F.col("intent_kind") == "invariant", "enforces").when(F.col("intent_kind") == "decision", "satisfies").otherwise("implements").alias("relation"),
        lexical.alias("lexical"), (F.col("s") * (STRUCTURAL // 10)).alias("structural"), (F.coalesce("t", F.lit(0)) * (TEST // 10)).alias("test"), (F.coalesce("d", F.lit(0)) * (DATA // 10)).alias("data"), (F.col("f") * (ARTIFACT // 10)).alias("artifact"),
    )
    total = F.col("lexical") + F.col("structural") + F.col("test") + F.col("data") + F.col("artifact")
    return out.withColumn("score", total).filter(F.col("score") >= keep)


def sharing(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """(intent, symbol) that share at least ``least`` terms, of (intent, t) and (symbol, t).

    Terms are ordered by how rare they are; a pair with enough common terms meets in one of the
    first n - least + 1 of both sides, so the common terms are never joined on.
    """
    sides = {"intent": left, "symbol": right}
    flat = {k: d.select(k, F.size("t").alias("n"), F.explode("t").alias("term")) for k, d in sides.items()}
    df = flat["intent"].select("term").unionByName(flat["symbol"].select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def rare(k: str) -> DataFrame:
        listed = flat[k].join(df, "term").groupBy(k).agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("o"))
        return listed.select(k, F.explode(F.slice("o", F.lit(1), F.greatest(F.size("o") - (least - 1), F.lit(0)))).alias("x")).select(k, F.col("x.term").alias("term"))

    met = rare("intent").join(rare("symbol"), "term").select("intent", "symbol").distinct()
    checked = met.join(left.withColumnRenamed("t", "a"), "intent").join(right.withColumnRenamed("t", "b"), "symbol")
    return checked.filter(F.size(F.array_intersect("a", "b")) >= least).select("intent", "symbol")
