"""Incremental index plan: which identity each definition of the changed files gets, and what retires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialise, observed

ROUNDS = 100


def symbol_key(language: Column, canonical: Column, kind: Column) -> Column:
    return F.concat(F.lit("symbol:"), language, F.lit(":"), canonical, F.lit(":"), F.initcap(kind))


def replaced_paths(changes: DataFrame, known: DataFrame) -> DataFrame:
    """(path) of the files whose structure a change replaces; ``known``: (path) of the index."""
    added = changes.filter("op = 'added'").select(F.col("new_path").alias("path")).join(known.select("path"), "path", "left_semi")
    return added.union(changes.filter("op <> 'added'").select("old_path")).distinct()


def _unique(prior: DataFrame, on: list[str], name: str) -> DataFrame:
    """(on..., name): the key where exactly one prior symbol fits."""
    found = prior.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias(name))
    return found.filter("n = 1").drop("n")


def candidates(prior: DataFrame, defs: DataFrame, changes: DataFrame) -> DataFrame:
    """Definitions with the keys they may take: exact, and the looser ones in order.

    ``prior``: key, language, file_path, canonical, name, kind, signature, shape; ``defs``: the same
    without key, with ``ord`` (their order over the transition). Exact: one prior symbol of the
    language has path and kind. Then one of the file before has name, kind and signature; one of a
    file the transition replaces has language, kind, name and shape; a symbol of the file before
    was renamed, unique in kind and shape both ways and gone by name. Absent signatures are equal.
    """
    known = prior.select(F.col("file_path").alias("path")).distinct()
    replaced = replaced_paths(changes, known).select(F.col("path").alias("file_path"))
    before = changes.filter("new_path is not null").select(F.col("new_path").alias("file_path"), F.coalesce("old_path", "new_path").alias("prior_path"))
    sign = lambda df: df.withColumn("sig", F.coalesce("signature", F.lit("\x00")))
    out = sign(defs).join(before, "file_path", "left")
    out = out.join(_unique(prior, ["language", "canonical", "kind"], "exact"), ["language", "canonical", "kind"], "left")
    here = sign(prior).withColumnRenamed("file_path", "prior_path")
    out = out.join(_unique(here, ["prior_path", "name", "kind", "sig"], "named"), ["prior_path", "name", "kind", "sig"], "left")
    vacated = prior.join(replaced, "file_path", "left_semi")
    out = out.join(_unique(vacated, ["language", "kind", "name", "shape"], "shaped"), ["language", "kind", "name", "shape"], "left")
    paths = defs.join(before, "file_path").select("prior_path", "canonical").distinct()
    gone = here.join(paths, ["prior_path", "canonical"], "left_anti")
    olds = _unique(gone, ["prior_path", "kind", "shape"], "renamed")
    fresh = out.join(here.select("prior_path", "canonical").distinct(), ["prior_path", "canonical"], "left_anti")
    news = fresh.groupBy("prior_path", "kind", "shape").agg(F.count(F.lit(1)).alias("m"), F.min("ord").alias("ord")).filter("m = 1").drop("m")
    return out.join(news.join(olds, ["prior_path", "kind", "shape"]).select("ord", "renamed"), "ord", "left")


def assign(found: DataFrame) -> DataFrame:
    """(ord, key) of the definitions that take a looser key.

    In order of the definitions each takes the first of its keys that is free; exact keys are
    reserved. As every key prefers the earlier definition, proposing in rounds gives just that:
    each definition asks for its next key, a key keeps the least one that ever asked.
    """
    reserved = found.select(F.explode(F.array_compact(F.array("exact"))).alias("key")).distinct()
    asked = found.select("ord", F.posexplode(F.array_compact(F.array("named", "shaped", "renamed"))).alias("at", "key"))
    asked = asked.join(reserved, "key", "left_anti").groupBy("ord", "key").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("at"))
    wishes = materialise(asked.select("ord", "key", rank.alias("wish")), "wishes")
    state = wishes.select("ord").distinct().withColumn("now", F.lit(1))
    for n in range(ROUNDS):
        asks = state.join(wishes, (state["ord"] == wishes["ord"]) & (state["now"] == wishes["wish"])).select(state["ord"], "now", "key")
        owner = asks.groupBy("key").agg(F.min("ord").alias("owner"))
        held = asks.join(owner, "key").select("ord", "key", "now", (F.col("ord") != F.col("owner")).alias("lost"))
        held, seen = observed(held, f"assign-{n}", lost=F.count_if(F.col("lost")))
        if not seen["lost"]:
            return held.select("ord", "key")
        out = state.join(held.select("ord"), "ord", "left_anti")
        state = held.select("ord", (F.col("now") + F.col("lost").cast("int")).alias("now")).unionByName(out)
    raise RuntimeError(f"{ROUNDS} rounds left keys unassigned")


def plan_symbols(prior: DataFrame, defs: DataFrame, changes: DataFrame) -> DataFrame:
    """(ord, file_path, canonical, key, mutation, stale) of every definition of the changed files.

    A definition without any prior match gets the key its own path makes, with ``#2``, ``#3``
    where that is taken. ``stale``: the version it replaces had another body.
    """
    found = materialise(candidates(prior, defs, changes), "candidates")
    taken = assign(found)
    out = found.join(taken, "ord", "left")
    base = symbol_key(F.col("language"), F.col("canonical"), F.col("kind"))
    matched = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in ("exact", "named", "shaped", "renamed")])
    out = out.withColumn("base", base).withColumn("matched", matched)
    used = out.filter("matched").select(F.coalesce("key", "exact", "base").alias("base")).distinct().withColumn("spoken", F.lit(1))
    new = out.filter("not matched").join(used, "base", "left")
    place = F.row_number().over(Window.partitionBy("base").orderBy("ord")) + F.coalesce("spoken", F.lit(0))
    new = new.select("ord", F.when(place == 1, F.col("base")).otherwise(F.concat("base", F.lit("#"), place)).alias("made"))
    keyed = out.join(new, "ord", "left").select("ord", "file_path", "canonical", "body", F.coalesce("made", "key", "base").alias("key"))
    was = prior.groupBy("key").agg(F.max("body").alias("was"))
    return keyed.join(was, "key", "left").select(
        "ord", "file_path", "canonical", "key", F.when(F.col("was").isNull(), "create").otherwise("version").alias("mutation"), F.coalesce(F.col("was") != F.col("body"), F.lit(False)).alias("stale")
    )


def retired(prior: DataFrame, planned: DataFrame, changes: DataFrame) -> DataFrame:
    """(key) of prior symbols of the files that changes replace, which no definition took over."""
    known = prior.select(F.col("file_path").alias("path")).distinct()
    replaced = replaced_paths(changes, known).select(F.col("path").alias("file_path"))
    return prior.join(replaced, "file_path", "left_semi").select("key").distinct().join(planned.select("key"), "key", "left_anti")


def summary(planned: DataFrame, gone: DataFrame, files: DataFrame) -> DataFrame:
    """One row of what a plan writes; a key that is written twice is an error row's count."""
    p = planned.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("mutation") == "create").alias("created"), F.count_if(F.col("mutation") == "version").alias("versioned"),
        F.count_if(F.col("stale")).alias("stale"), (F.count(F.lit(1)) - F.countDistinct("key")).alias("doubled"),
    )
    return p.join(gone.agg(F.count(F.lit(1)).alias("retired"))).join(files.agg(F.count(F.lit(1)).alias("files")))  # one row each


def entity_facts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, act) of nodes that facts create or retire: those only one side names."""
    b, a = (df.select(key).filter(F.col(key).isNotNull()).distinct() for df in (before, after))
    return a.join(b, key, "left_anti").withColumn("act", F.lit("create")).unionByName(b.join(a, key, "left_anti").withColumn("act", F.lit("retire")))


def numbered_keys(rows: DataFrame, base: str, order: list) -> DataFrame:
    """Rows with ``key``: the base itself, and ``#2``, ``#3`` for the ones that collide with it."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("key", F.when(place == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), place)))
