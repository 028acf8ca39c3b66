"""References to records that do not exist.

Two signed counts per key, summed from change deltas: references (+1 where one begins, -1 where it
ends) and existence (+1 where a record begins, -1 where it ends). Both are swept along the axis of
the key (commit numbers or microseconds); where references are positive and existence is zero the
key is orphaned. Sums of deltas are all the state there is: a change of a row adds its new deltas
and takes back the old ones (:class:`OrphanState`). The rows of orphaned keys are then held against
the orphaned stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import HOT_FLOOR, hot_keys, salted_join
from lodestone.session import materialise

ALWAYS = (1 << 63) - 1
DAY = 86_400_000_000
COMPACT = 8
DELTA = "key string, at long, refs long, live long, begun long"


def clean_key(key: Column) -> Column:
    """The key without surrounding blanks; null for a blank one."""
    bare = F.regexp_replace(key, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def _deltas(rows: DataFrame, steps: list[tuple[Column, int, int, int]]) -> DataFrame:
    """(key, at, refs, live, begun) of rows that count ``n`` times (default once; negative: taken back)."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    parts = [F.struct(at.cast("long").alias("at"), *[(n * d).cast("long").alias(c) for c, d in zip(("refs", "live", "begun"), ds)]) for at, *ds in steps]
    return rows.select("key", F.inline(F.array(*parts))).filter(F.col("key").isNotNull() & F.col("at").isNotNull())


def existence_deltas(records: DataFrame) -> DataFrame:
    """Deltas of records (key, start, end); one with an empty interval begins but never exists."""
    known = records.filter(F.col("start").isNotNull())
    empty = F.col("end").isNotNull() & (F.col("end") <= F.col("start"))
    real = lambda at: F.when(~empty, at)
    return _deltas(known, [(F.col("start"), 0, 0, 1), (real(F.col("start")), 0, 1, 0), (real(F.col("end")), 0, -1, 0)])


def reference_deltas(refs: DataFrame, grain: int = 1) -> DataFrame:
    """Deltas of references (key, lo, hi; null: open), their ends moved outward to multiples of
    ``grain``, which bounds the positions of a key that a third of all rows name.
    """
    real = refs.filter(F.col("hi").isNull() | (F.col("hi") > F.col("lo")))
    lo = F.col("lo") - F.pmod(F.col("lo"), F.lit(grain))
    hi = F.col("hi") + F.pmod(-F.col("hi"), F.lit(grain))
    return _deltas(real, [(lo, 1, 0, 0), (hi, -1, 0, 0)])


def summed(deltas: DataFrame) -> DataFrame:
    """One row per key and position, combined map-side; what cancels out is gone."""
    sums = deltas.groupBy("key", "at").agg(*[F.sum(c).alias(c) for c in ("refs", "live", "begun")])
    return sums.filter("refs <> 0 or live <> 0 or begun <> 0")


def orphaned_keys(sums: DataFrame) -> DataFrame:
    """(key, first, references, bare) of keys with positive references and zero existence somewhere.

    ``bare`` are those stretches, ``first`` is where the first record begins (null: there is none),
    ``references`` the number of references. The sweep sorts a key's positions, bounded by the axis
    and the grain, not its rows.
    """
    order = Window.partitionBy("key").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = sums.select(
        "key", "at", "refs", *[F.sum(c).over(upto).alias(f"{c}_now") for c in ("refs", "live", "begun")], F.coalesce(F.lead("at").over(order), F.lit(ALWAYS)).alias("next")
    )
    bare = F.when((F.col("refs_now") > 0) & (F.col("live_now") <= 0), F.struct(F.col("at").alias("lo"), F.col("next").alias("hi")))
    keys = swept.groupBy("key").agg(
        F.min(F.when(F.col("begun_now") > 0, F.col("at"))).alias("first"), F.sum(F.greatest("refs", F.lit(0))).alias("references"), F.collect_list(bare).alias("bare")
    )
    return keys.filter(F.size("bare") > 0)


def orphan_references(refs: DataFrame, records: DataFrame, hot_floor: int = HOT_FLOOR, grain: int = 1) -> DataFrame:
    """References that meet no live record at some position of theirs, with the reason.

    ``refs``: ref_table, ref_field, row_id, period, key, lo, hi (null: open); ``records``: key,
    start, end (null: open). Null keys are no references and empty intervals no cases. Reason
    ``missing``: no record has the key; ``late``: all begin after lo; else ``deleted``. Repeated
    rows come out once. Extra columns are ignored.

    A reference is a case exactly if it meets an orphaned stretch of its key: where it lies itself,
    references are positive. So only rows of orphaned keys are joined.
    """
    refs = refs.filter(F.col("key").isNotNull() & (F.col("hi").isNull() | (F.col("hi") > F.col("lo"))))
    deltas = reference_deltas(refs, grain).unionByName(existence_deltas(records))
    return cases(refs, materialise(orphaned_keys(summed(deltas)), "orphaned"), hot_floor)


def cases(refs: DataFrame, orphaned: DataFrame, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """The references that meet orphaned stretches of their keys."""
    hot = hot_keys(orphaned.select("key", "references"), "key", "references", floor=hot_floor)
    hi = F.coalesce("hi", F.lit(ALWAYS))
    met = salted_join(refs, orphaned, "key", F.col("row_id"), hot, "inner").filter(F.exists("bare", lambda g: (g.lo < hi) & (g.hi > F.col("lo"))))
    reason = F.when(F.col("first").isNull(), "missing").when(F.col("first") > F.col("lo"), "late").otherwise("deleted")
    return met.select("ref_table", "ref_field", "row_id", reason.alias("reason"), "period").distinct()


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that ``before`` lacks with n > 0, and rows it has too many of with n < 0."""
    cols = before.columns
    both = before.withColumn("n", F.lit(-1)).unionByName(after.select(*cols).withColumn("n", F.lit(1)))
    return both.groupBy(*cols).agg(F.sum("n").alias("n")).filter("n <> 0")


class OrphanState:
    """The summed deltas of all batches: each batch adds its own, every ``COMPACT``-th writes the sum.

    A batch is a numbered folder that a repeated run overwrites, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def sums(self, batches: int) -> DataFrame:
        """The state after the first ``batches`` batches."""
        if batches <= 0:
            return self.spark.createDataFrame([], DELTA)
        base = (batches - 1) // COMPACT * COMPACT
        paths = [f"{self.root}/whole={base}" if base else f"{self.root}/delta=0", *(f"{self.root}/delta={n}" for n in range(base + 1, batches))]
        return summed(self.spark.read.schema(DELTA).parquet(*paths))

    def apply(self, batch: int, deltas: DataFrame) -> DataFrame:
        """Add the deltas of a batch; the orphaned keys after it."""
        summed(deltas).write.mode("overwrite").parquet(f"{self.root}/delta={batch}")
        if batch and batch % COMPACT == 0:
            own = self.spark.read.schema(DELTA).parquet(f"{self.root}/delta={batch}")
            summed(self.sums(batch).unionByName(own)).write.mode("overwrite").parquet(f"{self.root}/whole={batch}")
        return orphaned_keys(self.sums(batch + 1))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references over the commits of the edge."""
    ends = F.array(
        *[F.struct(F.lit(f).alias("ref_field"), clean_key(F.col(f)).alias("key")) for f in ("src", "dst")]
    )
    return edges.select(
        F.lit("edges").alias("ref_table"),
        F.col("edge_id").alias("row_id"),
        month(F.col("recorded_at")).alias("period"),
        F.col("valid_from").alias("lo"),
        F.col("valid_to").alias("hi"),
        F.inline(ends),
    )


def node_records(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        clean_key(F.col("stable_key")).alias("key"), F.col("created_commit").alias("start"), F.col("retired_commit").alias("end")
    )


def path_of_url(url: Column) -> Column:
    """Path of an http(s) url without query and fragment; null for anything else."""
    rest = F.regexp_extract(F.trim(url), r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(F.trim(url).rlike(r"(?i)^https?://"), F.when(rest == "", "/").otherwise(rest))


def route(method: Column, path: Column) -> Column:
    """Key of a method and a path whose ``{...}`` segments are all ``{param}``."""
    shape = F.regexp_replace(F.trim(path), r"(?<=/)\{[^/]*\}(?=/|$)", "{param}")
    return F.concat_ws(" ", F.upper(F.trim(method)), F.when(shape != "", shape))


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def call_references(calls: DataFrame) -> DataFrame:
    """Every call as a reference at the instant it was recorded.

    The path template wins; without one the path comes from the url, and a url that is not
    http(s) makes no reference.
    """
    path = F.coalesce(clean_key(F.col("path_template")), path_of_url(F.col("url")))
    at = _micros(F.col("recorded_at"))
    return calls.select(
        F.lit("external_calls").alias("ref_table"),
        F.col("call_id").alias("row_id"),
        month(F.col("recorded_at")).alias("period"),
        at.alias("lo"),
        (at + 1).alias("hi"),
        F.lit("path_template").alias("ref_field"),
        F.when(path.isNotNull() & F.col("method").isNotNull(), route(F.col("method"), path)).alias("key"),
    )


def endpoint_records(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(
        route(F.col("method"), F.col("path")).alias("key"),
        _micros(F.col("published_at")).alias("start"),
        _micros(F.col("withdrawn_at")).alias("end"),
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """The current orphan report: cases per table, field, month and reason."""
    return found.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))
