"""What a change of the code means: paired symbols, moves, and findings for the intents behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.diff import change_kind, severity

CLAIMS = ("implements", "enforces", "satisfies", "depends_on")
SILENT = ("formatting_only", "rename", "refactor_likely")
VERBOSE_BP, QUIET_BP = 6500, 8500
SIDE = ("key", "canonical", "kind", "signature", "body", "shape")


def pair_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, b, a) of the symbols of a file before and after; a null side was added or deleted.

    Equal canonical paths pair first, then equal kinds and shapes in order of their paths. Two
    equi-joins; a file's symbols meet by path and shape, never as all pairs.
    """
    side = lambda df, n: df.select("file_path", "canonical", F.struct(*SIDE).alias(n))
    b, a = side(before, "b"), side(after, "a")
    same = b.join(a, ["file_path", "canonical"]).select("file_path", "b", "a")
    left = b.join(after.select("file_path", "canonical"), ["file_path", "canonical"], "left_anti")
    right = a.join(before.select("file_path", "canonical"), ["file_path", "canonical"], "left_anti")

    def numbered(df: DataFrame, n: str) -> DataFrame:
        df = df.withColumn("kind", F.col(f"{n}.kind")).withColumn("shape", F.col(f"{n}.shape"))
        return df.withColumn("k", F.row_number().over(Window.partitionBy("file_path", "kind", "shape").orderBy("canonical"))).drop("canonical")

    rest = numbered(left, "b").join(numbered(right, "a"), ["file_path", "kind", "shape", "k"], "full_outer").select("file_path", "b", "a")
    return same.unionByName(rest)


def changed_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, stable_key, old, new, change) of every symbol that is not the same on both sides.

    The key is that of the older side. A deleted and an added half of one key are one move.
    """
    pairs = pair_symbols(before, after)
    b, a = F.col("b"), F.col("a")
    differs = b.isNull() | a.isNull() | ~b["body"].eqNullSafe(a["body"]) | ~b["signature"].eqNullSafe(a["signature"]) | ~b["canonical"].eqNullSafe(a["canonical"])
    part = lambda s: {"path": s["canonical"], "signature": s["signature"], "body": s["body"], "shape": s["shape"]}
    rows = pairs.filter(differs).select(
        "file_path", F.coalesce(b["key"], a["key"]).alias("stable_key"), b["canonical"].alias("old"), a["canonical"].alias("new"), change_kind(part(b), part(a)).alias("change")
    )
    return merge_moves(rows)


def merge_moves(entities: DataFrame) -> DataFrame:
    """A key with exactly one deleted and one added half becomes one rename in the new file."""
    halves = entities.groupBy("stable_key").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("new").isNull(), F.col("old"))).alias("gone"), F.max(F.when(F.col("old").isNull(), F.struct("new", "file_path"))).alias("come")
    )
    moved = halves.filter("stable_key is not null and n = 2 and gone is not null and come is not null")
    whole = moved.select(F.col("come.file_path").alias("file_path"), "stable_key", F.col("gone").alias("old"), F.col("come.new").alias("new"), F.lit("rename").alias("change"))
    return entities.join(moved.select("stable_key"), "stable_key", "left_anti").select(*whole.columns).unionByName(whole)


def behavior_bp(change: Column) -> Column:
    """How sure a kind of change is one of behaviour, in basis points."""
    return F.when(change.isin("formatting_only", "rename", "contract_changed"), 10000).when(change == "refactor_likely", 7500).when(change == "behavior_potentially_changed", 9000).otherwise(6500)


# The words of suggested actions.
def suggested_action(intent_kind: Column, tests_changed: Column) -> Column:
    """What a reviewer should do about a finding."""
    act = F.lit("Verify the product intent remains accurate for this behavior change.")
    for kind in ("invariant", "requirement"):
        act = F.when((intent_kind == kind) & tests_changed, f"Verify the changed tests still protect this {kind}.").when(
            intent_kind == kind, f"Verify the {kind} still holds and review the unchanged related tests."
        ).otherwise(act)
    return act


def direct_findings(entities: DataFrame, claims: DataFrame, nodes: DataFrame, least_bp: int = VERBOSE_BP) -> DataFrame:
    """(changed, source, intent, intent_kind, change, severity, confidence_bp, via) of changes that reach an intent.

    ``claims``: src, dst, kind, status, confidence_bp, evidence_bp. The confidence of a finding is
    the least of change, claim and evidence.
    """
    loud = entities.filter(~F.col("change").isin(*SILENT) & F.col("stable_key").isNotNull()).select(F.col("stable_key").alias("src"), "change", F.coalesce("new", "old").alias("changed")).distinct()
    found = loud.join(_backing(claims, nodes), "src")
    return _graded(found.withColumn("via", F.lit(None).cast("string")), least_bp)


def _backing(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    intents = nodes.filter(F.col("kind").isin("feature", "requirement", "invariant", "decision")).select(F.col("stable_key").alias("dst"), F.col("kind").alias("intent_kind"))
    return claims.filter(F.col("kind").isin(*CLAIMS) & (F.col("status") == "active")).join(intents, "dst").select("src", "dst", "intent_kind", F.least("confidence_bp", "evidence_bp").alias("claim_bp")).distinct()


def _graded(found: DataFrame, least_bp: int) -> DataFrame:
    bp = F.least(behavior_bp(F.col("change")), F.col("claim_bp"))
    rows = found.select("changed", F.col("src").alias("source"), F.col("dst").alias("intent"), "intent_kind", "change", severity(F.col("intent_kind")).alias("severity"), bp.alias("confidence_bp"), "via")
    return rows.filter(F.col("confidence_bp") >= least_bp)


def indirect_findings(entities: DataFrame, claims: DataFrame, nodes: DataFrame, calls: DataFrame, direct: DataFrame, least_bp: int = VERBOSE_BP) -> DataFrame:
    """Findings at the callers of changed functions, one for each caller and intent.

    ``calls``: (caller, callee). Callers that are tests, and intents a direct finding of the caller
    names already, are left out. Of several changed functions the one with the longest path wins,
    the least of equally long ones. The choice is a map-side combined aggregate.
    """
    callable_ = nodes.filter("kind = 'code_symbol' and symbol_kind in ('function', 'method')").select(F.col("stable_key").alias("callee"))
    loud = entities.filter(~F.col("change").isin(*SILENT) & F.col("stable_key").isNotNull())
    helpers = loud.select(F.col("stable_key").alias("callee"), "change", F.coalesce("new", "old").alias("via")).distinct().join(callable_, "callee", "left_semi")
    real = nodes.filter(~F.col("is_test")).select(F.col("stable_key").alias("src"), F.col("identifier").alias("changed"))
    at = helpers.join(calls.select("callee", F.col("caller").alias("src")).distinct(), "callee").join(real, "src")
    found = _graded(at.join(_backing(claims, nodes), "src"), least_bp)
    known = direct.select("source", "intent").distinct()
    rest = found.join(known, ["source", "intent"], "left_anti")
    order = F.struct((-F.length("via")).alias("length"), "via", "change", "confidence_bp")
    best = rest.groupBy("source", "intent").agg(F.min_by(F.struct("changed", "intent_kind", "change", "severity", "confidence_bp", "via"), order).alias("f"))
    return best.select("f.changed", "source", "intent", "f.intent_kind", "f.change", "f.severity", "f.confidence_bp", "f.via")


def blocked(findings: DataFrame, destructive: DataFrame) -> DataFrame:
    """One row: whether each rule would fail the change.

    ``destructive``: one boolean column of that name for every schema or API change.
    """
    f = findings.agg(
        F.coalesce(F.max(F.col("severity") == "high"), F.lit(False)).alias("high"),
        F.coalesce(F.max(F.col("severity").isin("high", "medium")), F.lit(False)).alias("medium"),
        F.coalesce(F.max(F.col("intent_kind") == "invariant"), F.lit(False)).alias("invariant"),
    )
    return f.join(destructive.agg(F.coalesce(F.max("destructive"), F.lit(False)).alias("destructive")))  # one row each


def access_signals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(symbol, signal): what a symbol reads or writes now and did not, as one line of text.

    Both sides: (symbol, kind in reads_from, writes_to; target).
    """
    sets = lambda df, n: df.groupBy("symbol", "kind").agg(F.array_sort(F.collect_set("target")).alias(n))
    j = sets(before, "b").join(sets(after, "a"), ["symbol", "kind"], "full_outer")
    show = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("none"))
    word = F.when(F.col("kind") == "reads_from", "reads").otherwise("writes")
    text = F.concat(F.lit("database "), word, F.lit(" changed: "), show("b"), F.lit(" -> "), show("a"))
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("symbol", text.alias("signal"))


def api_description(kind: Column, method: Column, path: Column, details: Column) -> Column:
    """An API change as text."""
    verb = F.when(kind == "contract_modified", "changed").otherwise(kind)
    return F.concat(verb, F.lit(" "), method, F.lit(" "), path, F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""))


# Words of schema changes; {e} entity, {c} column.
SCHEMA_TEXT = {
    "table_created": "table {e} created", "table_dropped": "table {e} dropped", "column_added": "{e}.{c} added", "column_dropped": "{e}.{c} dropped", "column_type_changed": "{e}.{c} type changed",
    "nullability_tightened": "{e}.{c} became NOT NULL", "nullability_relaxed": "{e}.{c} became nullable", "default_changed": "{e}.{c} default changed", "primary_key_changed": "{e}.{c} primary-key membership changed",
    "foreign_key_changed": "{e}.{c} foreign-key target changed", "unique_added": "{e}.{c} unique constraint added", "unique_removed": "{e}.{c} unique constraint removed",
}


def schema_description(change: Column, entity: Column, column: Column) -> Column:
    """A schema change as text."""
    text = F.lit(None).cast("string")
    for name, words in SCHEMA_TEXT.items():
        text = F.when(change == name, F.replace(F.replace(F.lit(words), F.lit("{e}"), entity), F.lit("{c}"), F.coalesce(column, F.lit("")))).otherwise(text)
    return text


def findings_of_changes(changes: DataFrame, touching: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, destructive, changes, intents, tests) of each changed table or endpoint.

    ``changes``: (entity, destructive, text); ``touching``: (entity, symbol). Two hops and no more:
    the symbols at the entity, then what their active claims name.
    """
    own = changes.groupBy("entity").agg(F.max("destructive").alias("destructive"), F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("changes"))
    near = touching.distinct().join(claims.filter("status = 'active'").select(F.col("src").alias("symbol"), "dst", "kind").distinct(), "symbol")
    kinds = nodes.select(F.col("stable_key").alias("dst"), "identifier", "is_test")
    named = near.join(kinds, "dst")
    intent = F.when(F.col("kind").isin("implements", "enforces", "satisfies"), F.col("identifier"))
    test = F.when((F.col("kind") == "covered_by") & F.col("is_test"), F.col("identifier"))
    around = named.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set(intent)), ",").alias("intents"), F.array_join(F.array_sort(F.collect_set(test)), ",").alias("tests"))
    return own.join(around, "entity", "left").select("entity", "destructive", "changes", F.coalesce("intents", F.lit("")).alias("intents"), F.coalesce("tests", F.lit("")).alias("tests"))
