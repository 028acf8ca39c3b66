"""Change detection and classification between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., op) of keys added, deleted or modified; values compare null-safely.

    One full outer join on the keys. Each side has one row per key.
    """
    b = before.select(*keys, F.struct(*values).alias("_b"))
    a = after.select(*keys, F.struct(*values).alias("_a"))
    both = b.join(a, keys, "full_outer")
    op = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(*keys, op.alias("op")).filter(F.col("op").isNotNull())


def column_changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys..., field, old, new) for every compared field that differs, as text."""
    b = before.select(*keys, *[F.col(v).cast("string").alias(f"_b{i}") for i, v in enumerate(values)])
    a = after.select(*keys, *[F.col(v).cast("string").alias(f"_a{i}") for i, v in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"_b{i}").alias("old"), F.col(f"_a{i}").alias("new")) for i, v in enumerate(values)])
    return b.join(a, keys).select(*keys, F.inline(cells)).filter(~F.col("old").eqNullSafe(F.col("new")))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome, merged): unchanged, ours, theirs, same, or ambiguous where both sides differ.

    An absent row is a value of its own. The merged value of an ambiguous key is null.
    """
    side = lambda df, n: df.select(key, F.struct(F.col(value).alias("v")).alias(n))
    j = side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    same = F.col("o").eqNullSafe(F.col("t"))
    mine, other = F.col("o").eqNullSafe(F.col("b")), F.col("t").eqNullSafe(F.col("b"))
    outcome = F.when(mine & other, "unchanged").when(same, "same").when(other, "ours").when(mine, "theirs").otherwise("ambiguous")
    kept = F.when(outcome.isin("unchanged", "same", "ours"), F.col("o.v")).when(outcome == "theirs", F.col("t.v"))
    return j.select(key, outcome.alias("outcome"), kept.alias("merged"))


def change_kind(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """The ladder of kinds a symbol's change has; the sides give path, signature, body and shape.

    A missing side (null path) means the symbol was added or deleted.
    """
    diff = lambda k: ~before[k].eqNullSafe(after[k])
    return (
        F.when(before["path"].isNull() | after["path"].isNull(), "behavior_potentially_changed")
        .when(diff("signature"), "contract_changed")
        .when(diff("path") & ~diff("shape"), "rename")
        .when(~diff("body"), "refactor_likely")
        .when(~diff("shape"), "formatting_only")
        .otherwise("behavior_potentially_changed")
    )


def severity(kind: Column) -> Column:
    """How grave a change is for the intent that the changed code backs."""
    return F.when(kind.isin("invariant", "requirement"), "high").when(kind.isin("feature", "decision"), "medium").otherwise("low")


def schema_changes(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(entity, column, change, destructive) between two column lists.

    Columns: entity, name, data_type, nullable (null: not determined), primary_key, unique,
    foreign_key, default. ``renames``: (entity, previous) of columns that only changed name.
    Undetermined to required counts as tightened, required to undetermined as no change.
    """
    fields = ["data_type", "nullable", "primary_key", "unique", "foreign_key", "default"]
    b = before.select("entity", "name", F.struct(*fields).alias("b"))
    if renames is not None:
        b = b.join(renames.select("entity", F.col("previous").alias("name")), ["entity", "name"], "left_anti")
    j = b.join(after.select("entity", "name", F.struct(*fields).alias("a")), ["entity", "name"], "full_outer")
    was, now = lambda f: F.col(f"b.{f}"), lambda f: F.col(f"a.{f}")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = lambda f: both & ~was(f).eqNullSafe(now(f))
    row = lambda name, bad: F.struct(F.lit(name).alias("change"), F.lit(bad).alias("destructive"))
    cases = [
        (F.col("a").isNull(), row("column_dropped", True)),
        (F.col("b").isNull(), row("column_added", False)),
        (differs("data_type"), row("column_type_changed", True)),
        (both & F.coalesce(was("nullable"), F.lit(True)) & now("nullable").eqNullSafe(F.lit(False)), row("nullability_tightened", True)),
        (both & was("nullable").eqNullSafe(F.lit(False)) & now("nullable").eqNullSafe(F.lit(True)), row("nullability_relaxed", False)),
        (differs("default"), row("default_changed", False)),
        (differs("primary_key"), row("primary_key_changed", True)),
        (differs("foreign_key"), row("foreign_key_changed", True)),
        (both & ~was("unique") & now("unique"), row("unique_added", False)),
        (both & was("unique") & ~now("unique"), row("unique_removed", True)),
    ]
    found = F.array_compact(F.array(*[F.when(cond, r) for cond, r in cases]))
    return j.select("entity", F.col("name").alias("column"), F.inline(found))


def replay_columns(operations: DataFrame) -> DataFrame:
    """(entity, column) left after migrations, from (path, position, entity, op, column, new_name).

    ``op``: add, drop, rename. The last operation on a name decides, in path order: a rename drops
    the old name and adds the new one. A map-side combined aggregate; no ordered fold is needed.
    """
    sides = F.array_compact(
        F.array(
            F.struct(F.col("column").alias("name"), (F.col("op") == "add").alias("there")),
            F.when(F.col("op") == "rename", F.struct(F.col("new_name").alias("name"), F.lit(True).alias("there"))),
        )
    )
    steps = operations.select("entity", "path", "position", F.inline(sides))
    last = steps.groupBy("entity", "name").agg(F.max(F.struct("path", "position", "there")).alias("l"))
    return last.filter("l.there").select("entity", F.col("name").alias("column"))


def schema_divergence(models: DataFrame, migrations: DataFrame) -> DataFrame:
    """(entity, column, kind) of columns only one source declares, for entities both declare."""
    shared = models.select("entity").distinct().join(migrations.select("entity").distinct(), "entity", "left_semi")
    j = models.withColumn("m", F.lit(1)).join(migrations.withColumn("g", F.lit(1)), ["entity", "column"], "full_outer")
    kind = F.when(F.col("g").isNull(), "expected_by_orm_only").when(F.col("m").isNull(), "declared_by_migration_only")
    return j.join(shared, "entity", "left_semi").select("entity", "column", kind.alias("kind")).filter("kind is not null")


def api_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., kind, destructive, details) of endpoints removed, added or changed in contract.

    Each side: keys, params (array of name, location), return_type, framework; one row per key.
    """
    b = before.select(*keys, F.struct("params", "return_type", "framework").alias("b"))
    a = after.select(*keys, F.struct("params", "return_type", "framework").alias("a"))
    j = b.join(a, keys, "full_outer")
    names = lambda side: F.transform(F.coalesce(F.col(f"{side}.params"), F.array()), lambda p: p["name"])
    lost = F.array_sort(F.array_except(names("b"), names("a")))
    moved = F.array_sort(
        F.transform(
            F.filter(F.col("b.params"), lambda p: F.exists(F.col("a.params"), lambda q: (q["name"] == p["name"]) & ~q["location"].eqNullSafe(p["location"]))),
            lambda p: p["name"],
        )
    )
    fresh = F.array_sort(F.array_except(names("a"), names("b")))
    say = lambda prefix: lambda n: F.concat(F.lit(prefix), n)
    typed = F.when(
        ~F.col("b.return_type").eqNullSafe(F.col("a.return_type")),
        F.concat(F.lit("return type changed from "), F.coalesce("b.return_type", F.lit("unknown")), F.lit(" to "), F.coalesce("a.return_type", F.lit("unknown"))),
    )
    framed = F.when(
        ~F.col("b.framework").eqNullSafe(F.col("a.framework")), F.concat(F.lit("framework changed from "), F.col("b.framework"), F.lit(" to "), F.col("a.framework"))
    )
    details = F.concat(
        F.transform(lost, say("removed parameter ")), F.transform(moved, say("changed parameter ")),
        F.transform(fresh, say("added parameter ")), F.array_compact(F.array(typed, framed)),
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    kind = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.size(details) > 0, "contract_modified")
    grave = F.col("a").isNull() | (both & ((F.size(lost) > 0) | (F.size(moved) > 0) | (typed.isNotNull() & F.col("b.return_type").isNotNull())))
    text = F.when(both, F.array_join(details, "; ")).otherwise("")
    return j.select(*keys, kind.alias("kind"), F.coalesce(grave, F.lit(False)).alias("destructive"), text.alias("details")).filter("kind is not null")
