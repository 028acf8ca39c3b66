"""Processing only new or changed records.

A table's rows come in any order, and none of its columns says when a row came. So the consumer
keeps a change log of its own: rows not there yet, told by key and id, are appended as one numbered
segment. Every row of the log has a key, a log partition (a hash of the key) and an offset that
grows within the partition, the number of its segment. A run
  1. replays the plan of an earlier run that never committed, or else appends what arrived, plans
     the offset range of each partition and writes that plan ahead of any work;
  2. reads exactly the planned ranges, whose segments are folders of their own;
  3. hands the rows to the sink, which overwrites the folder of that batch and, when read,
     keeps one row per key and offset;
  4. commits the plan.
A failure before 4 leaves the plan behind: the next run repeats the same ranges into the same
folder, so no record is skipped and none comes out twice.

What earlier runs learned is kept per key (:class:`KeyState`), so a run reads what arrived, the
files it never read and one narrow row per key, not the log of all runs before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.session import FileStore

PARTITIONS = 64
COMPACT = 8


@dataclass(frozen=True)
class BatchPlan:
    """Half-open offset ranges ``(after[p], upto[p]]`` of each log partition."""

    batch: int
    after: tuple[int, ...]
    upto: tuple[int, ...]
    note: str = ""

    @property
    def empty(self) -> bool:
        return self.after == self.upto


class ChangeCapture:
    """Change log, write-ahead plans and commits of one consumer of a table.

    Plans under the root's own ``plans`` are of a former layout, ranges of ids; a consumer that
    left only those begins again.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = PARTITIONS):
        self.spark, self.root, self.partitions = spark, f"{root.rstrip('/')}/arrivals", partitions
        self.store = FileStore(spark, f"{self.root}/plans")

    def _numbered(self, suffix: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.store.names() if n.endswith(suffix) and not n.startswith("_"))

    def partition(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.partitions)).cast("int")

    def committed(self) -> BatchPlan | None:
        done = self._numbered(".done")
        return self._load(done[-1]) if done else None

    def _load(self, batch: int) -> BatchPlan:
        d = json.loads(self.store.read(f"{batch:08d}.plan"))
        return BatchPlan(d["batch"], tuple(d["after"]), tuple(d["upto"]), d.get("note", ""))

    def waiting(self) -> BatchPlan | None:
        """The plan that was written and never committed."""
        plans, done = self._numbered(".plan"), set(self._numbered(".done"))
        return self._load(plans[-1]) if plans and plans[-1] not in done else None

    def _segments(self, schema: StructType, first: int, count: int) -> DataFrame:
        """Segments ``first`` to ``count`` - 1 of the log; no other folder is listed or read."""
        whole = StructType([*schema.fields, StructField("segment", LongType())])
        if first >= count:
            return self.spark.createDataFrame([], whole)
        paths = [f"{self.root}/log/segment={n}" for n in range(first, count)]
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/log").parquet(*paths)

    def _append(self, table: DataFrame, key: str, offset: str, segment: int) -> None:
        """Write the rows that no earlier segment holds; a segment without a plan is written anew."""
        new = table.filter(F.col(key).isNotNull() & F.col(offset).isNotNull())
        if segment:
            new = new.join(self._segments(table.schema, 0, segment).select(key, offset), [key, offset], "left_anti")
        new.select(table.columns).write.mode("overwrite").parquet(f"{self.root}/log/segment={segment}")

    def plan(self, log: DataFrame, key: str, offset: str, note: str = "") -> BatchPlan:
        """The pending plan if one was never committed, else a new one, written before it is used.

        A plan without rows is written only where ``note`` differs from that of the last one.
        """
        if (left := self.waiting()) is not None:
            return left
        last = self.committed()
        after = last.upto if last else (-1,) * self.partitions
        batch = last.batch + 1 if last else 0
        self._append(log, key, offset, batch)
        arrived = self._segments(log.schema, batch, batch + 1)
        ends = dict(arrived.groupBy(self.partition(F.col(key)).alias("p")).agg(F.max("segment")).collect())
        upto = tuple(max(after[p], ends.get(p, -1)) for p in range(self.partitions))
        made = BatchPlan(batch, after, upto, note)
        if not made.empty or note != (last.note if last else ""):
            self.store.write(f"{made.batch:08d}.plan", json.dumps({"batch": made.batch, "after": after, "upto": upto, "note": note}))
        return made

    def _within(self, log: DataFrame, key: str, plan: BatchPlan, first: int, test: Callable[[Column, Column], Column]) -> DataFrame:
        at = self.partition(F.col(key)) + 1
        bound = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), at)
        return self._segments(log.schema, first, plan.batch + 1).filter(test(bound(plan.after), bound(plan.upto))).select(log.columns)

    def rows(self, log: DataFrame, key: str, plan: BatchPlan) -> DataFrame:
        """The log rows inside the planned ranges; null keys and ids are in no range."""
        return self._within(log, key, plan, min(plan.after) + 1, lambda after, upto: (F.col("segment") > after) & (F.col("segment") <= upto))

    def before(self, log: DataFrame, key: str, plan: BatchPlan) -> DataFrame:
        """All log rows that earlier runs read; what needs only the last row of a key keeps a KeyState."""
        return self._within(log, key, plan, 0, lambda after, upto: F.col("segment") <= after)

    def commit(self, plan: BatchPlan) -> None:
        if f"{plan.batch:08d}.done" not in self.store.names():
            self.store.write(f"{plan.batch:08d}.done", "")

    def unread(self, folder: str) -> DataFrame:
        """The rows of those Parquet files in ``folder`` that no committed run listed.

        A file counts as read only with the same length and time of change, so one that was
        written anew is read again; its old rows are told by key and id. The listing of a batch is
        a table; only the names of unread files come to the driver.
        """
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        files = files.select("path", "length", F.col("modificationTime").cast("long").alias("changed"))
        last = self.committed()
        batch = last.batch + 1 if last else 0
        if self.waiting() is None:
            files.write.mode("overwrite").parquet(f"{self.root}/files/batch={batch}")
        now = self.spark.read.schema(files.schema).parquet(f"{self.root}/files/batch={batch}")
        known = [f"{self.root}/files/batch={n}" for n in range(batch) if n in self._numbered(".done")]
        whole = self.spark.read.parquet(folder)
        if not known:
            return whole
        new = [r[0] for r in now.join(self.spark.read.schema(files.schema).parquet(*known), files.columns, "left_anti").select("path").collect()]
        return self.spark.read.schema(whole.schema).parquet(*new) if new else whole.limit(0)


class KeyState:
    """The greatest row of every key over all batches, by ``order``.

    A batch writes its rows alone; every ``COMPACT``-th one writes the whole state, so reading
    touches at most ``COMPACT`` folders. Folders of a batch are overwritten when it is replayed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: list[str]):
        self.spark, self.root, self.schema, self.key, self.order = spark, root.rstrip("/"), schema, key, order

    def _greatest(self, rows: DataFrame) -> DataFrame:
        names = [n for n in rows.columns if n != self.key and n not in self.order]
        best = rows.groupBy(self.key).agg(F.max(F.struct(*self.order, *names)).alias("v"))
        return best.select(*[F.col(self.key) if n == self.key else F.col(f"v.{n}").alias(n) for n in rows.columns])

    def batch(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/delta={n}")

    def read(self, batches: int) -> DataFrame:
        """The state after the first ``batches`` batches."""
        if batches <= 0:
            return self.spark.createDataFrame([], self.schema)
        base = (batches - 1) // COMPACT * COMPACT
        paths = [f"{self.root}/whole={base}" if base else f"{self.root}/delta=0", *(f"{self.root}/delta={n}" for n in range(base + 1, batches))]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return self._greatest(rows) if len(paths) > 1 else rows

    def write(self, n: int, rows: DataFrame) -> None:
        """Rows of batch ``n``, one per key."""
        rows.write.mode("overwrite").parquet(f"{self.root}/delta={n}")
        if n and n % COMPACT == 0:
            self._greatest(self.read(n).unionByName(self.batch(n))).write.mode("overwrite").parquet(f"{self.root}/whole={n}")


class KeyOffsetSink:
    """One folder per batch; reading keeps one row per key and offset."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, offset: str):
        self.spark, self.root, self.schema, self.key, self.offset = spark, root.rstrip("/"), schema, key, offset

    def write(self, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, batch: int) -> DataFrame:
        return self._read([f"{self.root}/batch={batch}"]).dropDuplicates([self.key, self.offset])


def run_batch(
    capture: ChangeCapture,
    sink: KeyOffsetSink,
    log: DataFrame,
    key: str,
    offset: str,
    process: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """One run: plan, process, write, commit. Returns what this run put into the sink.

    ``process(rows, earlier)`` gets the planned rows and all rows that earlier runs read.
    With nothing new the result is empty.
    """
    plan = capture.plan(log, key, offset)
    if plan.empty:
        return sink._read([])
    sink.write(plan.batch, process(capture.rows(log, key, plan), capture.before(log, key, plan)))
    capture.commit(plan)
    return sink.read(plan.batch)


def instant(text: Column) -> Column:
    """ISO-8601 text in any offset form as a timestamp; null where it is none."""
    colon = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.try_to_timestamp(colon)


VERSION_SCHEMA = "comment_id string, fetch_id long, at timestamp, external_id string, input_fingerprint string"


def comment_versions(comments: DataFrame) -> DataFrame:
    """Fetched comments as log rows: key, offset, instant, ledger id and fingerprint of the body.

    The body is hashed before any shuffle, so texts never travel. A null body hashes as the
    empty text; a row without comment id has no key.
    """
    return comments.select(
        "comment_id",
        "fetch_id",
        instant(F.coalesce("updated", "created")).alias("at"),
        F.concat("issue_key", F.lit("-comment-"), "comment_id").alias("external_id"),
        F.sha2(F.coalesce("body", F.lit("")), 256).alias("input_fingerprint"),
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """One row per comment: the latest instant, the greater fetch id on a tie.

    An aggregate with map-side combine, so a comment holding a third of all rows stays harmless.
    Unreadable instants count as earliest.
    """
    best = F.max(F.struct("at", "fetch_id", "external_id", "input_fingerprint")).alias("v")
    return versions.groupBy("comment_id").agg(best).select(
        "comment_id", "v.fetch_id", "v.at", "v.external_id", "v.input_fingerprint"
    )


def analysed(ledger: DataFrame, runs: DataFrame, provider: str = "jira", kind: str = "comment", whole: bool = False) -> DataFrame:
    """Per input the fingerprint that the greatest succeeded run left in the ledger.

    ``runs`` has one row per run, far below any broadcast limit; Spark checks its size itself.
    Two rows of one run are told apart by the greater ledger id. ``whole`` adds the run and the id.
    """
    good = runs.filter(F.col("run_status") == "succeeded").select("run_id").distinct()
    rows = ledger.filter((F.col("provider") == provider) & (F.col("kind") == kind)).join(good, "run_id", "left_semi")
    last = F.max(F.struct("run_id", "ledger_id", "input_fingerprint")).alias("v")
    more = [F.col("v.run_id").cast("long").alias("run_id"), F.col("v.ledger_id").cast("long").alias("ledger_id")] if whole else []
    return rows.groupBy("external_id").agg(last).select("external_id", *more, F.col("v.input_fingerprint").alias("analysed"))


STATE_SCHEMA = f"{VERSION_SCHEMA}, batch long, taken_by long, pending boolean"
LEDGER_SCHEMA = "external_id string, run_id long, ledger_id long, analysed string"
RUN_SCHEMA = "run_id long, run_status string"


def pending_comments(
    capture: ChangeCapture, sink: KeyOffsetSink, comments: DataFrame | str, ledger: DataFrame, runs: DataFrame, run_id: int | None = None
) -> DataFrame:
    """Comments the run ``run_id`` has to take up: new ones, and ones whose body changed.

    Returns comment_id and the fingerprint of its current version, once per comment. Later calls
    with the same ``capture`` judge only comments of which a row came since, whatever its fetch
    id; those whose ledger changed, because another run succeeded; and those a run took up that
    has ended since, by success or not. What a run took up that is still ``running`` is not taken
    up twice. Together the calls find what one call over all rows finds. Without ``run_id`` the
    call itself counts as the run, and its commit as success.

    ``comments`` may name a folder: then only files that no earlier call listed are read. A run
    that has succeeded is held to write no more ledger rows; where one is no longer called a
    success, everything is judged anew. Empty tables give no rows.
    """
    spark = capture.spark
    versions = KeyState(spark, f"{capture.root}/versions", STATE_SCHEMA, "comment_id", ["at", "fetch_id", "batch"])
    status_of = lambda n: spark.read.schema(RUN_SCHEMA).parquet(f"{capture.root}/runs/batch={n}")
    last = capture.committed()
    batch = last.batch + 1 if last else 0
    if capture.waiting() is None:
        now = runs.filter("run_id is not null").groupBy(F.col("run_id").cast("long").alias("run_id")).agg(F.max("run_status").alias("run_status"))
        now.write.mode("overwrite").parquet(f"{capture.root}/runs/batch={batch}")
    now = status_of(batch)
    before = status_of(last.batch) if last else spark.createDataFrame([], RUN_SCHEMA)
    good, was_good = (s.filter("run_status = 'succeeded'").select("run_id") for s in (now, before))
    anew = not was_good.join(good, "run_id", "left_anti").isEmpty()
    epoch = batch if anew or not last else json.loads(last.note)["epoch"]
    states = str(now.agg(F.sum(F.xxhash64("run_id", "run_status").cast("decimal(38,0)"))).first()[0])
    log = comment_versions(capture.unread(comments) if isinstance(comments, str) else comments)
    plan = capture.plan(log, "comment_id", "fetch_id", json.dumps({"epoch": epoch, "runs": states}))
    if plan.empty and last and plan.note == last.note:
        return sink._read([]).select("comment_id", "input_fingerprint")

    epoch = json.loads(plan.note)["epoch"]
    known = KeyState(spark, f"{capture.root}/known/{epoch}", LEDGER_SCHEMA, "external_id", ["run_id", "ledger_id"])
    news = good if epoch == batch else good.join(was_good, "run_id", "left_anti")
    known.write(batch - epoch, analysed(ledger, news.withColumn("run_status", F.lit("succeeded")), whole=True))
    gained = known.batch(batch - epoch).select("external_id", F.lit(True).alias("gained"))
    ledger_now = known.read(batch - epoch + 1).select("external_id", "analysed")

    seen = versions.read(batch)
    arrived = current_versions(capture.rows(log, "comment_id", plan))
    newer = arrived.join(seen.select("comment_id", F.struct("at", "fetch_id").alias("seen")), "comment_id", "left").filter(
        F.col("seen").isNull() | (F.struct("at", "fetch_id") > F.col("seen"))
    )
    newer = newer.select(*arrived.columns)
    judged = newer
    if batch:
        held = seen.join(now, seen["taken_by"] == now["run_id"], "left").filter(~F.coalesce(F.col("run_status") == "running", F.lit(False)))
        touched = F.lit(epoch == batch) | F.col("gained") | F.col("taken_by").isNotNull()
        again = held.join(gained, "external_id", "left").filter(touched).select(*arrived.columns)
        judged = newer.unionByName(again.join(newer.select("comment_id"), "comment_id", "left_anti"))
    open_ = ~F.col("input_fingerprint").eqNullSafe(F.col("analysed"))
    judged = judged.join(ledger_now, "external_id", "left").withColumn("pending", open_).select(
        *[F.col(c) for c in arrived.columns], F.lit(batch).cast("long").alias("batch"),
        F.when(F.col("pending"), F.lit(run_id)).cast("long").alias("taken_by"), "pending",
    )
    versions.write(batch, judged)
    sink.write(batch, versions.batch(batch).filter("pending").select("comment_id", "fetch_id", "at", "external_id", "input_fingerprint"))
    capture.commit(plan)
    return sink.read(batch).select("comment_id", "input_fingerprint")
