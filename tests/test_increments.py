import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import increments as inc
from lodestone.session import scratch

COMMENTS = "fetch_id long, comment_id string, issue_key string, body string, display_name string, created string, updated string, fetched_at timestamp, batch string"
LEDGER = "ledger_id long, provider string, kind string, external_id string, input_fingerprint string, run_id long, analyzed_at timestamp"
RUNS = "run_id long, run_status string"


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def parts(spark, name):
    root = scratch(spark, name)
    return inc.ChangeCapture(spark, root, 8), inc.KeyOffsetSink(spark, f"{root}/sink", inc.VERSION_SCHEMA, "comment_id", "fetch_id")


def comments(spark, *rows):
    return spark.createDataFrame([(*r, None, "x") for r in rows], COMMENTS)


def ledger(spark, *rows):
    return spark.createDataFrame([(i, "jira", "comment", e, f, r, None) for i, (e, f, r) in enumerate(rows)], LEDGER)


def test_current_version_and_ledger(spark, rows):
    c = comments(
        spark,
        (1, "a", "K-1", "old", None, "2024-01-01T10:00:00.000+0000", None),
        (2, "a", "K-1", "new", None, "2024-01-01T10:00:00.000+0000", "2024-01-02T00:00:00+05:30"),
        (2, "a", "K-1", "new", None, "2024-01-01T10:00:00.000+0000", "2024-01-02T00:00:00+05:30"),
        (3, "b", "K-1", None, None, "2024-01-01T00:00:00Z", None),
        (4, "c", "K-2", "same", None, "2024-01-01T00:00:00.000-0500", "2024-01-01T06:00:00Z"),
        (5, "c", "K-2", "late fetch of an older version", None, "2024-01-01T00:00:00Z", "2024-01-01T05:59:59Z"),
        (6, "d", "K-2", "tie one", None, "2024-01-01T00:00:00Z", None),
        (7, "d", "K-2", "tie two", None, "2024-01-01T01:00:00+0100", None),
        (8, None, "K-2", "no key", None, "2024-01-01T00:00:00Z", None),
        (9, "e", "K-3", "was failed", None, "2024-01-01T00:00:00Z", None),
    )
    led = ledger(
        spark, ("K-1-comment-a", sha("old"), 1), ("K-1-comment-b", sha(""), 2), ("K-2-comment-c", sha("other"), 1), ("K-2-comment-c", sha("same"), 2),
        ("K-3-comment-e", sha("was failed"), 3),
    )
    runs = spark.createDataFrame([(1, "succeeded"), (2, "succeeded"), (3, "failed")], RUNS)
    found = inc.pending_comments(*parts(spark, "t1"), c, led, runs)
    assert rows(found) == sorted([("a", sha("new")), ("d", sha("tie two")), ("e", sha("was failed"))])


def test_empty_tables(spark):
    found = inc.pending_comments(*parts(spark, "t2"), comments(spark), ledger(spark), spark.createDataFrame([], RUNS))
    assert found.count() == 0 and found.columns == ["comment_id", "input_fingerprint"]


def test_only_new_rows_are_read(spark, rows):
    capture, sink = parts(spark, "t3")
    none, runs = ledger(spark), spark.createDataFrame([], RUNS)
    first = comments(spark, (1, "a", "K-1", "x", None, "2024-01-01T00:00:00Z", None), (2, "b", "K-1", "y", None, "2024-01-03T00:00:00Z", None))
    assert inc.pending_comments(capture, sink, first, none, runs).count() == 2
    assert inc.pending_comments(capture, sink, first, none, runs).count() == 0
    more = first.union(comments(spark, (3, "a", "K-1", "z", None, "2024-01-05T00:00:00Z", None), (4, "b", "K-1", "older", None, "2024-01-02T00:00:00Z", None)))
    assert rows(inc.pending_comments(capture, sink, more, none, runs)) == [("a", sha("z"))]


def test_smaller_fetch_ids_that_come_later_are_read(spark, rows):
    capture, sink = parts(spark, "t5")
    none, runs = ledger(spark), spark.createDataFrame([], RUNS)
    first = comments(spark, *((n, f"k{n}", "K-1", "x", None, "2024-01-01T00:00:00Z", None) for n in range(100, 140)))
    assert inc.pending_comments(capture, sink, first, none, runs).count() == 40
    late = [(n, f"k{n + 100}", "K-1", f"y{n}", None, "2024-01-02T00:00:00Z", None) for n in range(40)]
    more = first.union(comments(spark, *late))
    assert rows(inc.pending_comments(capture, sink, more, none, runs)) == sorted((k, sha(body)) for _, k, _, body, *_ in late)
    assert inc.pending_comments(capture, sink, more, none, runs).count() == 0


def test_late_version_of_an_analysed_comment_is_not_taken_up(spark, rows):
    capture, sink = parts(spark, "t6")
    led, runs = ledger(spark, ("K-1-comment-a", sha("now"), 1)), spark.createDataFrame([(1, "succeeded")], RUNS)
    first = comments(spark, (5, "a", "K-1", "now", None, "2024-01-01T00:00:00Z", "2024-01-05T00:00:00Z"))
    assert inc.pending_comments(capture, sink, first, led, runs).count() == 0
    late = [(n, "a", "K-1", f"older {n}", None, "2024-01-01T00:00:00Z", "2024-01-04T00:00:00Z") for n in (4, 6)]
    more = first.union(comments(spark, *late))
    assert inc.pending_comments(capture, sink, more, led, runs).count() == 0
    newer = more.union(comments(spark, (1, "a", "K-1", "newest", None, "2024-01-01T00:00:00Z", "2024-01-06T00:00:00Z")))
    assert rows(inc.pending_comments(capture, sink, newer, led, runs)) == [("a", sha("newest"))]


def test_failed_run_is_replayed_without_gap_or_repeat(spark, rows):
    capture, sink = parts(spark, "t4")
    log = spark.range(100).select(F.col("id").cast("string").alias("comment_id"), F.col("id").alias("fetch_id"), F.lit(None).cast("timestamp").alias("at"), F.lit("e").alias("external_id"), F.lit("f").alias("input_fingerprint"))

    def broken(new, earlier):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        inc.run_batch(capture, sink, log, "comment_id", "fetch_id", broken)
    planned = capture.plan(log, "comment_id", "fetch_id")
    grown = log.union(log.withColumn("fetch_id", F.col("fetch_id") + 1000))
    assert capture.plan(grown, "comment_id", "fetch_id") == planned  # the same ranges again

    def half(new, earlier):
        out = new.withColumn("at", F.lit(None).cast("timestamp"))
        return out.union(out)  # delivered twice

    real = capture.commit
    capture.commit = lambda plan: (_ for _ in ()).throw(RuntimeError("lost before the commit"))
    with pytest.raises(RuntimeError):
        inc.run_batch(capture, sink, grown, "comment_id", "fetch_id", half)
    capture.commit = real
    again = inc.run_batch(capture, sink, grown, "comment_id", "fetch_id", half)
    assert again.count() == 100
    rest = inc.run_batch(capture, sink, grown, "comment_id", "fetch_id", lambda n, e: n)
    assert rest.count() == 100 and rest.agg(F.min("fetch_id")).first()[0] == 1000


@pytest.mark.parametrize(
    "text,want",
    [("2024-01-01T10:00:00.000+0200", dt.datetime(2024, 1, 1, 8)), ("2024-01-01T10:00:00Z", dt.datetime(2024, 1, 1, 10)), ("2024-01-01T10:00:00+05:30", dt.datetime(2024, 1, 1, 4, 30)), ("yesterday", None), ("", None), (None, None)],
)
def test_instant(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(inc.instant(F.col("t")).cast("timestamp_ntz"))
    assert df.first()[0] == want


class Tables:
    """A growing log, ledger and runs; ``whole`` is what one run over everything finds."""

    def __init__(self, spark):
        self.spark, self.comments, self.ledger, self.runs = spark, [], [], {}

    def frames(self):
        led = [(i, "jira", "comment", e, f, r, None) for i, (e, f, r) in enumerate(self.ledger)]
        return comments(self.spark, *self.comments), self.spark.createDataFrame(led, LEDGER), self.spark.createDataFrame(list(self.runs.items()), RUNS)

    def whole(self):
        now = {}
        for f, k, issue, body, _, created, updated in self.comments:
            now[k] = max(now.get(k, ("", -1)), ((updated or created), f, issue, body))
        known = {}
        for i, (e, f, r) in enumerate(self.ledger):
            if self.runs.get(r) == "succeeded":
                known[e] = max(known.get(e, (-1,)), (r, i, f))
        return {(k, sha(body)) for k, (_, _, issue, body) in now.items() if known.get(f"{issue}-comment-{k}", (0, 0, None))[2] != sha(body)}


@pytest.mark.parametrize("seed", [2])
def test_many_runs_equal_one_over_everything(spark, seed):
    import random

    rng = random.Random(seed)
    capture, sink = parts(spark, f"t7-{seed}")
    t, ids = Tables(spark), list(range(1000))
    rng.shuffle(ids)
    for run in range(1, 12):
        for _ in range(rng.randint(0, 6)):  # late, out of order, versions of old comments
            k = f"k{rng.randint(0, 9)}"
            at = f"2024-01-{rng.randint(1, 28):02d}T00:00:00Z"
            t.comments.append((ids.pop(), k, "K-1", f"text {rng.randint(0, 3)}", None, at, None))
        if t.comments and rng.random() < 0.5:
            t.comments.append(rng.choice(t.comments))
        if rng.random() < 0.3 and t.ledger:  # a run of others changes what is known
            t.runs[1000 + run] = "succeeded"
            t.ledger.append((rng.choice(t.ledger)[0], sha(f"text {rng.randint(0, 3)}"), 1000 + run))
        if run == 9:
            t.runs[1] = "failed"  # a success is taken back: everything is judged anew
        want = t.whole()
        got = inc.pending_comments(capture, sink, *t.frames(), run_id=run).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want), run
        done = rng.random() < 0.6
        t.runs[run] = "succeeded" if done else rng.choice(["failed", "aborted"])
        left = [r for r in sorted(map(tuple, got)) if done or rng.random() < 0.5]
        t.ledger += [(f"K-1-comment-{k}", f, run) for k, f in left]


def test_what_a_running_run_holds_is_not_taken_up_twice(spark, rows):
    capture, sink = parts(spark, "t8")
    t = Tables(spark)
    t.comments = [(1, "a", "K-1", "x", None, "2024-01-01T00:00:00Z", None)]
    assert rows(inc.pending_comments(capture, sink, *t.frames(), run_id=1)) == [("a", sha("x"))]
    t.runs[1] = "running"
    t.comments.append((2, "b", "K-1", "y", None, "2024-01-01T00:00:00Z", None))
    assert rows(inc.pending_comments(capture, sink, *t.frames(), run_id=2)) == [("b", sha("y"))]
    t.runs |= {1: "failed", 2: "running"}
    assert rows(inc.pending_comments(capture, sink, *t.frames(), run_id=3)) == [("a", sha("x"))]


def test_files_once_read_are_not_read_again(spark, rows, tmp_path):
    capture, sink = parts(spark, "t9")
    none, runs = ledger(spark), spark.createDataFrame([], RUNS)
    folder = f"file://{tmp_path}/log"
    comments(spark, (1, "a", "K-1", "x", None, "2024-01-01T00:00:00Z", None)).coalesce(1).write.parquet(folder)
    assert inc.pending_comments(capture, sink, folder, none, runs).count() == 1
    assert capture.unread(folder).count() == 0
    assert inc.pending_comments(capture, sink, folder, none, runs).count() == 0
    more = [(2, "b", "K-1", "y", None, "2024-01-01T00:00:00Z", None), (1, "a", "K-1", "x", None, "2024-01-01T00:00:00Z", None)]
    comments(spark, *more).coalesce(1).write.mode("append").parquet(folder)
    assert capture.unread(folder).count() == 2
    assert rows(inc.pending_comments(capture, sink, folder, none, runs)) == [("b", sha("y"))]


def test_a_run_lost_while_it_writes_is_repeated(spark, rows):
    capture, sink = parts(spark, "t10")
    t = Tables(spark)
    t.comments = [(1, "a", "K-1", "x", None, "2024-01-01T00:00:00Z", None)]
    real, sink.write = sink.write, lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost"))
    with pytest.raises(RuntimeError):
        inc.pending_comments(capture, sink, *t.frames(), run_id=1)
    sink.write = real
    t.comments.append((2, "b", "K-1", "y", None, "2024-01-01T00:00:00Z", None))
    assert rows(inc.pending_comments(capture, sink, *t.frames(), run_id=1)) == [("a", sha("x"))]
    t.runs[1] = "succeeded"
    t.ledger = [("K-1-comment-a", sha("x"), 1)]
    assert rows(inc.pending_comments(capture, sink, *t.frames(), run_id=2)) == [("b", sha("y"))]
