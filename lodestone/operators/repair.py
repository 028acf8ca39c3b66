"""Links that point nowhere any more, what they may have meant, and verdicts on claims as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.graph import Graph

SUGGESTIONS = 5


def document_links(nodes: DataFrame) -> DataFrame:
    """(document, symbol, ordinal) of the anchors of every document, each once."""
    return nodes.filter("anchors is not null").select(F.col("stable_key").alias("document"), F.inline("anchors")).select("document", "symbol", "fingerprint", "ordinal").distinct()


def drift(links: DataFrame, current: DataFrame, past: DataFrame) -> DataFrame:
    """(document, symbol, class, target) of links whose symbol is no current one.

    ``current`` and ``past``: (name, key, shape). R1: the symbol was retired and exactly one current
    symbol has its shape; R2: exactly one current symbol ends in its last name; R3: several do; R4:
    none does. Joins by whole name, shape and last name.
    """
    last = lambda c: F.regexp_extract(c, r"([^.:]+)$", 1)
    broken = links.select("document", "symbol").distinct().join(current.select(F.col("name").alias("symbol")), "symbol", "left_anti")
    shapes = current.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("by_shape")).filter("n = 1").select("shape", "by_shape")
    was = past.select(F.col("name").alias("symbol"), "shape").join(shapes, "shape").groupBy("symbol").agg(F.countDistinct("by_shape").alias("k"), F.min("by_shape").alias("by_shape")).filter("k = 1").drop("k")
    tails = current.select(last(F.col("name")).alias("tail"), "name").distinct().groupBy("tail").agg(F.count(F.lit(1)).alias("tails"), F.min("name").alias("by_tail"))
    j = broken.join(was, "symbol", "left").withColumn("tail", last(F.col("symbol"))).join(tails, "tail", "left")
    kind = F.when(F.col("by_shape").isNotNull(), "R1").when(F.col("tails") == 1, "R2").when(F.col("tails") > 1, "R3").otherwise("R4")
    target = F.when(F.col("by_shape").isNotNull(), F.col("by_shape")).when(F.col("tails") == 1, F.col("by_tail"))
    return j.select("document", "symbol", kind.alias("class"), target.alias("target"))


def suggested(broken: DataFrame, current: DataFrame, count: int = SUGGESTIONS) -> DataFrame:
    """(document, symbol, rank, name) of the first current symbols with a broken link's last name."""
    last = lambda c: F.regexp_extract(c, r"([^.:]+)$", 1)
    few = current.select(last(F.col("name")).alias("tail"), "name").distinct()
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("tail").orderBy("name"))).filter(F.col("rank") <= count)
    return broken.select("document", "symbol").distinct().withColumn("tail", last(F.col("symbol"))).join(few, "tail").select("document", "symbol", "rank", "name")


def applied(links: DataFrame, repairs: DataFrame) -> DataFrame:
    """Links with the repairs of class R1 and R2 in place of what they named."""
    sure = repairs.filter("class in ('R1', 'R2')").select("document", "symbol", "target")
    new = links.join(sure, ["document", "symbol"], "left")
    return new.withColumn("symbol", F.coalesce("target", "symbol")).select(*links.columns).distinct()


def unmapped_proposals(unmapped: DataFrame, candidates: DataFrame, count: int = SUGGESTIONS) -> DataFrame:
    """(intent, rank, symbol, score): the best candidates of documents nothing implements."""
    found = candidates.join(unmapped.select(F.col("stable_key").alias("intent")), "intent", "left_semi")
    order = Window.partitionBy("intent").orderBy(F.col("score").desc(), "symbol")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select("intent", "rank", "symbol", "score")


def rejected_stale(graph: Graph) -> DataFrame:
    """(fingerprint, document, symbol) of rejected claims that stay in a document: to be taken out."""
    intents = graph.nodes.filter(F.col("kind").isin("feature", "requirement", "invariant", "decision")).select(F.col("stable_key").alias("dst"))
    rejected = graph.edges.filter("status = 'rejected' and kind in ('implements', 'enforces', 'satisfies', 'covered_by', 'depends_on')")
    return rejected.join(intents, "dst", "left_semi").select("fingerprint", F.col("dst").alias("document"), F.col("src").alias("symbol")).distinct()


# --- verdicts -----------------------------------------------------------------------------------


def recorded(claims: DataFrame, verdicts: DataFrame, at: int) -> DataFrame:
    """Claims and the rows that verdicts add: nothing is overwritten.

    ``claims``: fingerprint, src, dst, kind, claim_class, source_kind, confidence_bp, status,
    producer, valid_from; ``verdicts``: (fingerprint, verdict in accept, reject). An accepted
    inference stays and gets a human assertion beside it, a rejected one gets a rejected record. Of
    several verdicts that differ none counts.
    """
    one = verdicts.filter("verdict in ('accept', 'reject')").groupBy("fingerprint").agg(F.countDistinct("verdict").alias("n"), F.min("verdict").alias("verdict")).filter("n = 1").drop("n")
    base = claims.filter("claim_class = 'inference'").dropDuplicates(["fingerprint"]).join(one, "fingerprint")
    yes = F.col("verdict") == "accept"
    added = base.select(
        F.concat("fingerprint", F.when(yes, ":human").otherwise(":rejected")).alias("fingerprint"), "src", "dst", "kind", F.when(yes, "assertion").otherwise("inference").alias("claim_class"),
        F.when(yes, "human").otherwise(F.col("source_kind")).alias("source_kind"), F.when(yes, 10000).otherwise(F.col("confidence_bp")).cast("int").alias("confidence_bp"),
        F.when(yes, "active").otherwise("rejected").alias("status"), F.lit("verification").alias("producer"), F.lit(at).cast("long").alias("valid_from"),
    )
    known = claims.select("fingerprint").distinct()
    return claims.select(*added.columns).unionByName(added.join(known, "fingerprint", "left_anti"))


def reactivated(claims: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Claims with the stale ones among ``confirmed`` (fingerprint, note) active again, and their note."""
    own = confirmed.groupBy("fingerprint").agg(F.max("note").alias("_note"))
    j = claims.join(own, "fingerprint", "left")
    hit = (F.col("status") == "stale") & F.col("_note").isNotNull()
    new = {"status": F.when(hit, "active").otherwise(F.col("status")), "stale_reason": F.when(~hit, F.col("stale_reason"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in claims.columns], F.when(hit, F.col("_note")).alias("annotation"))


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (id, state, ...) with pending ones moved to what was decided: (id, decision)."""
    own = decisions.groupBy("id").agg(F.max("decision").alias("_to"))
    return candidates.join(own, "id", "left").withColumn("state", F.when((F.col("state") == "pending") & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("state"))).select(*candidates.columns)


def offered(queue: DataFrame, incoming: DataFrame, decided_: DataFrame) -> DataFrame:
    """The queue with incoming candidates that are neither in it nor decided already, by fingerprint."""
    fresh = incoming.dropDuplicates(["fingerprint"]).join(queue.select("fingerprint"), "fingerprint", "left_anti").join(decided_.select("fingerprint"), "fingerprint", "left_anti")
    return queue.unionByName(fresh.select(*queue.columns))


def cascade(artifacts: DataFrame, links: DataFrame, ledger: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts, links and ledger rows without those of the ids in ``gone``."""
    ids = gone.select("id").distinct()
    left = artifacts.join(ids, "id", "left_anti")
    rest = links.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return left, rest, ledger.join(ids.withColumnRenamed("id", "external_id"), "external_id", "left_anti")


def first_free(taken: DataFrame, stem: str) -> DataFrame:
    """(stem, number): the least number from 1 on that no key ``STEM-nnn`` of a stem has."""
    parts = taken.select(F.regexp_extract(stem, r"^(.*)-\d+$", 1).alias("stem"), F.regexp_extract(stem, r"-(\d+)$", 1).cast("long").alias("n")).filter("stem <> '' and n > 0").distinct()
    placed = parts.withColumn("k", F.row_number().over(Window.partitionBy("stem").orderBy("n")))
    gap = placed.groupBy("stem").agg(F.min(F.when(F.col("n") != F.col("k"), F.col("k"))).alias("gap"), F.max("k").alias("last"))
    return gap.select("stem", F.coalesce("gap", F.col("last") + 1).alias("number"))


def batches(rows: DataFrame, group: str, order: list, size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows with ``batch``: filled in order until a row or byte bound would be passed.

    The bound starts anew with each batch, which no window expresses; a group's rows are folded as
    pairs of numbers in order. Groups are split by ``group`` beforehand.
    """
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("_size", size.cast("long"))
    lists = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", "_size"))).alias("all"))
    start = F.struct(F.lit(0).alias("rows"), F.lit(0).cast("long").alias("bytes"), F.lit(1).alias("batch"), F.array().cast("array<struct<_n:int,batch:int>>").alias("out"))

    def step(acc, x):
        over = (acc["rows"] > 0) & ((acc["rows"] >= most_rows) | (acc["bytes"] + x["_size"] > most_bytes))
        batch = acc["batch"] + over.cast("int")
        return F.struct(
            F.when(over, F.lit(1)).otherwise(acc["rows"] + 1).alias("rows"), F.when(over, x["_size"]).otherwise(acc["bytes"] + x["_size"]).alias("bytes"), batch.alias("batch"),
            F.concat(acc["out"], F.array(F.struct(x["_n"].alias("_n"), batch.alias("batch")))).alias("out"),
        )

    at = lists.select(group, F.inline(F.aggregate("all", start, step)["out"]))
    return ranked.join(at, [group, "_n"]).drop("_n", "_size")
