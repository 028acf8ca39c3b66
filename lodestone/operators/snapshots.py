"""Trees of files at commits, changes between trees, branches, and which merge requests texts ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_at(files: DataFrame, at: int) -> DataFrame:
    """(path, content_hash) of the files there at a commit: the newest version of each up to it."""
    return files.filter(F.col("commit_seq") <= at).groupBy("path").agg(F.max_by("content_hash", F.struct("commit_seq", "content_hash")).alias("content_hash"))


def blobs(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, at, chars) of each wanted path at a commit; null where it was not there.

    ``wanted``: (path, at); ``files``: (path, commit_seq, chars). An as-of join by path.
    """
    found = wanted.join(files, "path", "left")
    value = F.max_by("chars", F.when(F.col("commit_seq") <= F.col("at"), F.col("commit_seq")))
    return found.groupBy("path", "at").agg(value.alias("chars"))


def tree_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, old_path, new_path): added, deleted and modified files; equal content that stands once on
    either side makes a rename of a deleted and an added one."""
    b, a = before.select("path", F.col("content_hash").alias("bh")), after.select("path", F.col("content_hash").alias("ah"))
    j = b.join(a, "path", "full_outer")
    gone, come = j.filter("ah is null").select("path", F.col("bh").alias("h")), j.filter("bh is null").select("path", F.col("ah").alias("h"))
    once = lambda df, n: df.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("path").alias(n)).filter("k = 1").drop("k")
    moved = once(gone, "old_path").join(once(come, "new_path"), "h").select(F.lit("renamed").alias("op"), "old_path", "new_path")
    none = F.lit(None).cast("string")
    deleted = gone.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").select(F.lit("deleted"), "path", none)
    added = come.join(moved.select(F.col("new_path").alias("path")), "path", "left_anti").select(F.lit("added"), none, "path")
    changed = j.filter("ah <> bh").select(F.lit("modified"), "path", F.col("path").alias("p2"))
    return moved.union(deleted).union(added).union(changed)


def own_commits(commits: DataFrame, default: DataFrame, count: int) -> DataFrame:
    """(branch, commit, rank): the newest commits of each branch that the default one does not have.

    ``commits``: (branch, commit, seq); ``default``: one row naming the branch.
    """
    base = commits.join(F.broadcast(default), "branch", "left_semi").select("commit").distinct()  # default: one row
    others = commits.join(F.broadcast(default), "branch", "left_anti").join(base, "commit", "left_anti")
    order = Window.partitionBy("branch").orderBy(F.col("seq").desc(), "commit")
    return others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select("branch", "commit", "rank")


def grounded_requests(requests: DataFrame, iids: DataFrame, branches: DataFrame, shas: DataFrame, known: DataFrame) -> DataFrame:
    """Merge requests whose number, source branch or one of whose commits the repository names, and
    that are not known yet. The three ways are semi-joins of their own, not one disjunction.

    ``requests``: external_id, iid, branch, shas.
    """
    by = lambda df, column, refs, name: df.join(refs.select(F.col(name).alias(column)).distinct(), column, "left_semi").select("external_id")
    flat = requests.select("external_id", F.explode("shas").alias("sha"))
    hit = by(requests, "iid", iids, "iid").union(by(requests, "branch", branches, "branch")).union(by(flat, "sha", shas, "sha")).distinct()
    return requests.join(hit, "external_id", "left_semi").join(known.select("external_id"), "external_id", "left_anti")
