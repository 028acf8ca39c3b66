"""Small joins and choices over links, records, checks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which kind of reference may name which kind of artifact; the strings of the link signals.
MAY_NAME = {"ticket_key": ("issue",), "issue_number": ("issue",), "merge_request_number": ("merge_request", "pull_request"), "url": ("issue", "merge_request", "pull_request", "commit")}
SIGNALS = {"lexical": "shared terms", "structural": "near code that is mapped", "test": "a covering test calls it", "data": "touches the same data", "artifact": "changed by a linked artifact"}
EFFECTS = 8


def may_match(reference: Column, artifact: Column) -> Column:
    """Whether a kind of reference can stand for a kind of artifact."""
    out = F.lit(False)
    for kind, targets in MAY_NAME.items():
        out = F.when(reference == kind, artifact.isin(*targets)).otherwise(out)
    return out


def controlled(calls: Column, regions: Column) -> Column:
    """Names of calls (name, line) inside any region (lo, hi), sorted, each once: no shuffle."""
    inside = F.filter(calls, lambda c: F.exists(regions, lambda r: (c["line"] >= r["lo"]) & (c["line"] <= r["hi"])))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda c: c["name"])))


def only(values: Column) -> Column:
    """The one value of a group that has exactly one distinct one, else null (an aggregate)."""
    return F.when(F.countDistinct(values) == 1, F.min(values))


def unique_callees(calls: DataFrame, names: DataFrame) -> DataFrame:
    """(caller, name, callee) of called names that exactly one outgoing call of the caller has.

    ``calls``: (caller, callee); ``names``: (callee, name).
    """
    return calls.distinct().join(names, "callee").groupBy("caller", "name").agg(only(F.col("callee")).alias("callee")).filter("callee is not null")


def effects_of(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, effects): the first distinct effect strings of a symbol, sorted."""
    return rows.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_set(text)), 1, EFFECTS), "; ").alias("effects"))


def told(signals: list[str]) -> Column:
    """What a link's signals say, those that count anything."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(s) > 0, F.concat(F.lit(SIGNALS[s] + " ("), F.col(s).cast("string"), F.lit(")"))) for s in signals])), ", ")


def merges(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """(cluster, kept, merged) of clusters in which at least two members were accepted: the least stays.

    ``pairs``: (member, cluster); ``decided``: (member) of accepted ones.
    """
    own = pairs.join(decided.distinct(), "member", "left_semi").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("kept"))
    groups = own.filter("n >= 2").select("cluster", "kept")
    return pairs.join(decided.distinct(), "member", "left_semi").join(groups, "cluster").filter("member <> kept").select("cluster", "kept", F.col("member").alias("merged"))


def upsert_links(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links (src, target, kind, locator) with incoming ones in place of equal ones; a null target is a value."""
    keys = ["src", "target", "kind"]
    fresh = incoming.groupBy(*keys).agg(F.max("locator").alias("locator"))
    on = [current[c].eqNullSafe(fresh[c]) for c in keys]
    return current.join(fresh, on, "left_anti").unionByName(fresh)


def after_failures(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """Changes (op, old_path, new_path) when some files cannot be analysed: what is there of them goes.

    A modified file is deleted, an added one is no change, of a renamed one the old path is deleted.
    """
    j = changes.join(failed.select(F.col("path").alias("new_path"), F.lit(True).alias("_bad")), "new_path", "left")
    bad = F.coalesce("_bad", F.lit(False))
    kept = j.filter(~(bad & (F.col("op") == "added")))
    return kept.select(F.when(bad, "deleted").otherwise(F.col("op")).alias("op"), "old_path", F.when(~bad, F.col("new_path")).alias("new_path"))


def evaluated(checks: DataFrame, results: DataFrame) -> DataFrame:
    """(case, kind, passed) of typed checks: contains, absent, at_least, equals.

    ``checks``: case, kind, value, number; ``results``: case, value.
    """
    rows = results.distinct()
    sizes = rows.groupBy("case").agg(F.count(F.lit(1)).alias("n"))
    hit = checks.join(rows.withColumn("_there", F.lit(True)), ["case", "value"], "left").join(sizes, "case", "left")
    there, n = F.coalesce("_there", F.lit(False)), F.coalesce("n", F.lit(0))
    passed = F.when(F.col("kind") == "contains", there).when(F.col("kind") == "absent", ~there).when(F.col("kind") == "at_least", n >= F.col("number")).when(F.col("kind") == "equals", n == F.col("number")).otherwise(F.lit(False))
    return hit.select("case", "kind", passed.alias("passed"))


def review_sample(rows: DataFrame, group: str, item: str, labelled: Column, seed: str) -> DataFrame:
    """(group, item, place): a fifth of each group by hash, rounded up, without the labelled ones."""
    mark = F.sha2(F.concat(F.lit(seed), F.col(item).cast("string")), 256)
    order = Window.partitionBy(group).orderBy(mark)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    placed = rows.withColumn("place", F.row_number().over(order)).join(sizes, group).filter(F.col("place") <= F.ceil(F.col("_n") / 5))
    return placed.filter(~F.coalesce(labelled, F.lit(False))).select(group, item, "place")


def extended(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(group, kept, places): whether a frozen order (group, place, item) is the beginning of the order now."""
    j = frozen.join(now.withColumnRenamed("item", "_now"), ["group", "place"], "left")
    return j.groupBy("group").agg(F.min(F.col("item").eqNullSafe(F.col("_now"))).alias("kept"), F.count(F.lit(1)).alias("places"))


def head_reference(reference: Column) -> Column:
    """(commit, worktree) of an index reference: ``worktree@<oid>`` or the commit itself; null if neither."""
    oid = F.lower(F.regexp_extract(F.trim(reference), r"(?i)^(?:worktree@)?([0-9a-f]{4,64})$", 1))
    return F.struct(F.when(oid != "", oid).alias("commit"), F.when(oid != "", F.trim(reference).startswith("worktree@")).alias("worktree"))


def rendered_columns(rows: DataFrame) -> DataFrame:
    """(entity, text): a table and its columns as one line of text."""
    marks = F.concat_ws(" ", F.when(F.col("primary_key"), "PK"), F.when(F.col("nullable") == F.lit(False), "NOT NULL"), F.when(F.col("unique"), "UNIQUE"))
    cell = F.concat("name", F.lit(" "), "data_type", F.when(marks != "", F.concat(F.lit(" "), marks)).otherwise(""))
    return rows.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(cell)), ", ").alias("c")).select("entity", F.concat("entity", F.lit(" ("), "c", F.lit(")")).alias("text"))
