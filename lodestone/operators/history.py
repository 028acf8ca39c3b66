"""History of changing entity attributes as a bitemporal ledger.

Every delivered row is an assertion: a value over a valid interval, known since it was recorded. A
row of a snapshot speaks for the stretch up to the next snapshot, an update for the interval it
names. The sweep-line cuts the valid time of a key at the ends of all its intervals; in each
stretch the row recorded last supersedes the others, which stay in the ledger with the time they
were replaced. Neighbouring stretches of one assertion with one fate are one ledger row again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_FLOOR, hot_keys, salted_join
from lodestone.session import FileStore, materialise

OPEN = -1
DAY = 86_400_000_000
LEDGER = ("fingerprint", "status", "valid_from", "valid_to", "recorded_from", "recorded_to", "superseded")


def slots_of(snapshots: DataFrame) -> DataFrame:
    """(slot, whole) of every snapshot; a commit with several rows is complete if one of them is."""
    rows = snapshots.filter(F.col("commit_seq").isNotNull())
    return rows.groupBy(F.col("commit_seq").cast("long").alias("slot")).agg(F.coalesce(F.max("is_complete"), F.lit(False)).alias("whole"))


def complete(snapshots: DataFrame, count: int) -> list[int]:
    """The last ``count`` complete snapshots, the newest first."""
    return [r[0] for r in slots_of(snapshots).filter("whole").orderBy(F.col("slot").desc()).limit(count).collect()]


def axis_of(slots: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(slot, next, next_whole): the snapshot after each one, and the next complete one.

    Commits that only ``rows`` name are slots too. One row per commit that was ever shown: the one
    window without a key runs over these alone. Written, so its size decides how it is joined.
    """
    if rows is not None:
        extra = rows.select(F.col("commit_seq").cast("long").alias("slot")).dropna().distinct()
        slots = slots.unionByName(extra.withColumn("whole", F.lit(False))).groupBy("slot").agg(F.max("whole").alias("whole"))
    later = Window.orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    return materialise(slots.select("slot", F.min("slot").over(later).alias("next"), F.min(F.when(F.col("whole"), F.col("slot"))).over(later).alias("next_whole")), "axis")


def assertions(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(fingerprint, status, valid_from, valid_to, recorded_at) from rows with commit_seq or with
    valid_from/valid_to (null: open). Empty intervals and rows without fingerprint assert nothing.
    """
    status = F.lower(F.regexp_replace("status", r"\s+", "")).alias("status")
    kept = rows.filter(F.col("fingerprint").isNotNull())
    if "commit_seq" not in rows.columns:
        real = kept.filter(F.col("valid_from").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))
        return real.select("fingerprint", status, F.col("valid_from").cast("long"), F.col("valid_to").cast("long"), "recorded_at")
    axis = slots if "next" in slots.columns else axis_of(slots, rows)
    shown = kept.select("fingerprint", status, F.col("commit_seq").cast("long").alias("valid_from"), "recorded_at")
    ends = axis.select(F.col("slot").alias("valid_from"), F.col("next").alias("valid_to"))
    return shown.join(ends, "valid_from").select("fingerprint", "status", "valid_from", "valid_to", "recorded_at")


def _hot(asserted: DataFrame, floor: int) -> list[str]:
    return hot_keys(asserted.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprint", "n", floor=floor)


def _stretches(once: DataFrame, hot: list[str]) -> DataFrame:
    """Each assertion once per stretch it covers: its key's valid time is cut at all ends of intervals.

    The cuts of a key are as many as the axis has positions; hot keys are dealt out.
    """
    ends = once.select("fingerprint", F.explode(F.array("valid_from", "valid_to")).alias("p")).filter("p is not null").distinct()
    cuts = ends.groupBy("fingerprint").agg(F.array_sort(F.collect_list("p")).alias("cuts"))
    joined = salted_join(once, cuts, "fingerprint", F.xxhash64("valid_from", "valid_to", "recorded_at", "status"), hot, "inner")
    inside = F.filter("cuts", lambda p: (p >= F.col("valid_from")) & (F.col("valid_to").isNull() | (p <= F.col("valid_to"))))
    parts = F.transform(inside, lambda p, i: F.struct(p.alias("lo"), F.get(inside, i + 1).alias("hi")))
    real = F.filter(parts, lambda s: F.col("valid_to").isNull() | (s.lo < F.col("valid_to")))
    return joined.select("fingerprint", "status", "valid_from", "valid_to", "recorded_at", F.inline(real))


def bitemporal_ledger(asserted: DataFrame, split: bool = True, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """The ledger: (fingerprint, status, valid_from, valid_to, recorded_from, recorded_to, superseded).

    A null valid_to is open, a row with ``superseded`` false is still believed and has a null
    recorded_to. Rows are never overwritten: a later one only closes the recorded interval of what
    it overlaps. Of rows recorded at one time the greater status wins; without a time a row counts
    as earliest. ``split=False`` leaves out the cutting, for assertions no two of which overlap
    but in whole, as those of one axis of snapshots.

    A key and stretch meet in one task; those of keys that hold a large share of all rows are cut
    by day of recording as well, and the ends of the days joined afterwards.
    """
    hot = _hot(asserted, hot_floor)
    day = F.coalesce(F.floor(F.unix_micros(F.col("recorded_at").cast("timestamp")) / DAY), F.lit(-(1 << 40)))
    if split:
        parts = _stretches(asserted.distinct(), hot)
    else:
        parts = asserted.select("*", F.col("valid_from").alias("lo"), F.col("valid_to").alias("hi"))
    keys = ["fingerprint", "lo", *(["bucket"] if hot else [])]
    if hot:
        parts = parts.withColumn("bucket", F.when(F.col("fingerprint").isin(hot), day))
    # the copies of a row meet where its stretch is ordered: one exchange for both
    parts = parts.repartition(*keys).distinct()
    order = ["recorded_at", F.col("status").asc_nulls_first(), "valid_from", "valid_to"]
    within = Window.partitionBy(*keys).orderBy(*order)
    after = F.lead(F.struct("recorded_at")).over(within)
    if hot:
        firsts = parts.filter("bucket is not null").groupBy(*keys).agg(F.min(F.struct("recorded_at")).alias("first"))
        days = Window.partitionBy("fingerprint", "lo").orderBy("bucket")
        following = firsts.select(*keys, F.lead("first").over(days).alias("following"))
        parts = parts.withColumn("after", after).join(following, keys, "left")
        after = F.coalesce("after", "following")
    rows = parts.select(
        "fingerprint", "status", "valid_from", "valid_to", "lo", "hi", F.col("recorded_at").alias("recorded_from"), after.alias("after")
    )
    rows = rows.withColumn("recorded_to", F.col("after.recorded_at")).withColumn("superseded", F.col("after").isNotNull())
    if not split:
        return rows.select(*LEDGER)
    own = Window.partitionBy("fingerprint", "status", "valid_from", "valid_to", "recorded_from").orderBy("lo")
    fate = F.struct("recorded_to", "superseded")
    fresh = F.when(F.lag(fate).over(own).eqNullSafe(fate), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("fingerprint", "status", "valid_from", "valid_to", "recorded_from", "island").agg(
        F.min("lo").alias("lo"), F.when(F.count("hi") == F.count(F.lit(1)), F.max("hi")).alias("hi"), F.first("recorded_to").alias("recorded_to"), F.first("superseded").alias("superseded")
    )
    return whole.select("fingerprint", "status", F.col("lo").alias("valid_from"), F.col("hi").alias("valid_to"), "recorded_from", "recorded_to", "superseded")


def believed(ledger: DataFrame, as_of=None) -> DataFrame:
    """The slice of the ledger believed at ``as_of`` (default: now): one row per key and stretch."""
    if as_of is None:
        return ledger.filter("not superseded")
    known = F.col("recorded_from").isNull() | (F.col("recorded_from") <= F.lit(as_of))
    return ledger.filter(known & (~F.col("superseded") | (F.col("recorded_to") > F.lit(as_of))))


def versions(current: DataFrame, axis: DataFrame) -> DataFrame:
    """Versions (fingerprint, status, valid_from, valid_to) of the believed rows of snapshots.

    A null status means unchanged. A version ends at the next row with another status, or at the
    next complete snapshot that lacks the claim; -1 if neither comes. An incomplete snapshot that
    lacks it says nothing. A key has at most one row per snapshot here.
    """
    order = Window.partitionBy("fingerprint").orderBy("slot")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    at = current.select("fingerprint", "status", F.col("valid_from").alias("slot")).join(axis.select("slot", "next_whole"), "slot")
    shown = at.select(
        "fingerprint", "slot", "next_whole", F.last("status", ignorenulls=True).over(upto).alias("status"), F.lead("slot").over(order).alias("after")
    ).filter(F.col("status").isNotNull())
    shown = shown.withColumn("gone", F.when(F.col("next_whole") < F.coalesce("after", F.lit(1 << 62)), F.col("next_whole")))
    same = F.lag("status").over(order).eqNullSafe(F.col("status")) & F.lag("gone").over(order).isNull()
    marked = shown.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(upto))
    end = F.coalesce("gone", "after", F.lit(OPEN))
    return marked.groupBy("fingerprint", "run").agg(
        F.first("status").alias("status"), F.min("slot").alias("valid_from"), F.max_by(end, "slot").alias("e")
    ).select("fingerprint", "status", F.col("valid_from").cast("long"), F.col("e").cast("long").alias("valid_to"))


def intervals(current: DataFrame) -> DataFrame:
    """Versions of the believed rows of updates: neighbours of one status become one; -1: open."""
    order = Window.partitionBy("fingerprint").orderBy("valid_from")
    known = current.filter(F.col("status").isNotNull())
    joined = F.lag("status").over(order).eqNullSafe(F.col("status")) & F.lag("valid_to").over(order).eqNullSafe(F.col("valid_from"))
    marked = known.withColumn("fresh", F.when(joined, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("fingerprint", "run").agg(
        F.first("status").alias("status"), F.min("valid_from").alias("valid_from"), F.max(F.coalesce("valid_to", F.lit(1 << 62))).alias("e")
    ).select("fingerprint", "status", "valid_from", F.when(F.col("e") == 1 << 62, F.lit(OPEN)).otherwise(F.col("e")).cast("long").alias("valid_to"))


def status_history(rows: DataFrame, snapshots: DataFrame, as_of=None, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """Full status history of each claim from periodic snapshots or interval updates, off its ledger.

    Rows without fingerprint are ignored; a claim that never showed a status has no version;
    extra columns are dropped before the first shuffle.
    """
    if "commit_seq" not in rows.columns:
        return intervals(believed(bitemporal_ledger(assertions(rows, snapshots), True, hot_floor), as_of))
    axis = axis_of(slots_of(snapshots), rows)
    return versions(believed(bitemporal_ledger(assertions(rows, axis), False, hot_floor), as_of), axis)


class LedgerStore:
    """A ledger kept over many deliveries.

    Assertions are only ever appended. A delivery writes the ledger of the keys it touches as a
    batch of its own; earlier batches stay, and the newest one of a key is its ledger. A delivery
    that was lost before its commit is repeated into the same folders.
    """

    SCHEMA = "fingerprint string, status string, valid_from long, valid_to long, recorded_from timestamp, recorded_to timestamp, superseded boolean"
    ASSERTED = "fingerprint string, status string, valid_from long, valid_to long, recorded_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.commits = spark, root.rstrip("/"), FileStore(spark, f"{root.rstrip('/')}/commits")

    def batches(self) -> int:
        return len([n for n in self.commits.names() if n.endswith(".done") and not n.startswith("_")])

    def _read(self, kind: str, schema: str, count: int) -> DataFrame:
        if not count:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        paths = [f"{self.root}/{kind}/batch={n}" for n in range(count)]
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def deliver(self, asserted: DataFrame) -> int:
        n = self.batches()
        stamped = asserted.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
        stamped.distinct().write.mode("overwrite").parquet(f"{self.root}/assertions/batch={n}")
        every = self._read("assertions", self.ASSERTED, n + 1)
        touched = every.filter(F.col("batch") == n).select("fingerprint").distinct()
        own = every.join(touched, "fingerprint", "left_semi").drop("batch")
        bitemporal_ledger(own).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={n}")
        self.commits.write(f"{n:08d}.done", "")
        return n

    def read(self) -> DataFrame:
        rows = self._read("ledger", self.SCHEMA, self.batches())
        newest = rows.groupBy("fingerprint").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["fingerprint", "batch"], "left_semi").drop("batch")
