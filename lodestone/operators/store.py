"""Writing state: published snapshots, merges and reconciliation.

Tables are immutable. A change makes the next version of every table in a folder of its own and
publishes all of them with one renamed pointer file, so readers see either all or nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import FileStore


class SnapshotStore:
    """Versions of a set of tables under one root; the newest pointer names what is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointers = FileStore(spark, f"{self.root}/pointers")

    def version(self) -> int:
        """The published version; -1 before the first."""
        seen = [int(n.split(".")[0]) for n in self.pointers.names() if n.endswith(".json")]
        return max(seen, default=-1)

    def tables(self) -> dict[str, str]:
        v = self.version()
        return json.loads(self.pointers.read(f"{v:08d}.json")) if v >= 0 else {}

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.tables()[table])

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write the given tables and point to them; tables left out stay as they are.

        ``expected``: the version the changes were made from; if another writer published since,
        the rename of the pointer fails and nothing changes.
        """
        base = self.version() if expected is None else expected
        paths = self.tables() if base == self.version() else {}
        if base != self.version():
            raise RuntimeError(f"version {self.version()} was published after {base}")
        for name, df in tables.items():
            path = f"{self.root}/{name}/v={base + 1}"
            df.write.mode("overwrite").parquet(path)
            paths[name] = path
        self.pointers.write(f"{base + 1:08d}.json", json.dumps(paths, sort_keys=True))
        return base + 1


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows by key, incoming ones before current ones, the newest by ``order`` within a side."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_side")]
    best = F.max_by(F.struct(*rest), F.struct("_side", *order)).alias("_v")
    return both.groupBy(*keys).agg(best).select(*keys, "_v.*")


def scd2_merge(history: DataFrame, state: DataFrame, keys: list[str], values: list[str], at: int) -> DataFrame:
    """History after the state as of commit ``at`` is taken in: (keys, values, valid_from, valid_to).

    Open rows whose key is gone or whose values differ close at ``at``; new and changed keys open
    there. Rows that the same commit opened are rewritten, not closed: what it opened before and
    does not confirm disappears, and what it closed opens again first.
    """
    columns = [*keys, *values, "valid_from", "valid_to"]
    before = history.filter(F.col("valid_from") < at).select(*keys, *values, "valid_from", F.when(F.col("valid_to") < at, F.col("valid_to")).alias("valid_to"))
    done, open_ = before.filter("valid_to is not null"), before.filter("valid_to is null")
    new = state.select(*keys, F.struct(*values).alias("_new")).dropDuplicates(keys)
    old = open_.select(*keys, F.struct(*values).alias("_old"), "valid_from")
    both = old.join(new, keys, "full_outer")
    same = F.col("_new").eqNullSafe(F.col("_old"))
    kept = both.filter(F.col("_old").isNotNull()).select(*keys, "_old.*", "valid_from", F.when(~same, F.lit(at)).cast("long").alias("valid_to"))
    opened = both.filter(F.col("_new").isNotNull() & ~same).select(*keys, "_new.*", F.lit(at).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return done.select(*columns).unionByName(kept.select(*columns)).unionByName(opened.select(*columns))


def create_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and those incoming ones whose key is not there yet, once each."""
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def reconcile(current: DataFrame, identities: DataFrame, keys: list[str], scope) -> DataFrame:
    """Current rows without those in ``scope`` (a condition) that are no longer among the identities."""
    inside = current.filter(F.coalesce(scope, F.lit(False))).join(identities.select(*keys).distinct(), keys, "left_semi")
    return current.filter(~F.coalesce(scope, F.lit(False))).unionByName(inside.select(*current.columns))


def replace_of(current: DataFrame, incoming: DataFrame, owner: list[str]) -> DataFrame:
    """All rows of the owners that come in are replaced by the incoming ones; others stay."""
    return current.join(incoming.select(*owner).distinct(), owner, "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns).distinct())


def unreferenced(rows: DataFrame, key: str, links: DataFrame, link_key: str) -> DataFrame:
    """Rows that no link refers to any more."""
    return rows.join(links.select(F.col(link_key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def retire(nodes: DataFrame, edges: DataFrame, gone: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and claims after keys are retired: open facts at them close, other claims turn stale."""
    keys = gone.select("stable_key", F.lit(True).alias("_gone")).distinct()
    n = nodes.join(keys, "stable_key", "left")
    n = n.withColumn("retired_commit", F.when(F.col("_gone") & F.col("retired_commit").isNull(), F.lit(at)).otherwise(F.col("retired_commit"))).select(*nodes.columns)
    ends = lambda side: keys.select(F.col("stable_key").alias(side), F.col("_gone").alias(f"_{side}"))
    e = edges.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left")
    hit = F.coalesce("_src", "_dst", F.lit(False)) & F.col("valid_to").isNull()
    fact = F.col("claim_class") == "fact"
    e = e.withColumn("valid_to", F.when(hit & fact, F.lit(at)).otherwise(F.col("valid_to"))).withColumn(
        "stale_reason", F.when(hit & ~fact & (F.col("status") == "active"), "implementation_changed").otherwise(F.col("stale_reason"))
    )
    return n, e.withColumn("status", F.when(hit & ~fact & (F.col("status") == "active"), "stale").otherwise(F.col("status"))).select(*edges.columns)
