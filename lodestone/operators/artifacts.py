"""Development artifacts, the links between them and the scope a project keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialise

HISTORY = 20


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key by the given columns: a map-side combined aggregate."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_v")).select(key, "_v.*")


def issue_links(issues: DataFrame) -> DataFrame:
    """(a, b) between an issue and each key it links to or has as parent."""
    keys = F.array_union(F.coalesce("linked_keys", F.array()), F.array_compact(F.array("parent_key")))
    return issues.select(F.col("issue_key").alias("a"), F.explode(keys).alias("b")).filter("a <> b").distinct()


def related(direct: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """(key, depth) of the issues at most ``depth`` links from a direct one, with the least depth.

    Unrolled joins over links seen from both ends; each level is cut off in the shared folder.
    """
    around = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    level = direct.select("key").distinct().withColumn("depth", F.lit(0))
    found = level
    for n in range(1, depth + 1):
        step = level.join(around, level["key"] == around["a"]).select(F.col("b").alias("key")).distinct()
        level = materialise(step.join(found.select("key"), "key", "left_anti").withColumn("depth", F.lit(n)), f"related-{n}")
        found = found.unionByName(level)
    return found


def history(links: DataFrame, subject: str, when: str, item: str, limit: int = HISTORY) -> DataFrame:
    """The newest ``limit`` items of each subject, with their rank; undated ones come last.

    The limit is the feature: a rank filter that Spark applies before the shuffle as well.
    """
    order = Window.partitionBy(subject).orderBy(F.col(when).desc_nulls_last(), F.col(item).desc())
    return links.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def scope_plan(artifacts: DataFrame, links: DataFrame, issue_depths: DataFrame) -> DataFrame:
    """(id, disposition, reason) of each artifact by a ladder of reasons.

    ``artifacts``: id, provider, kind, parent (of a comment, else null). ``links``: (id, issue) of
    literal references. ``issue_depths``: (key, depth) of issues in scope. An artifact is kept if
    it names an issue in scope, is one, or is a comment on one; otherwise the reason tells why not.
    """
    named = links.join(issue_depths.select(F.col("key").alias("issue")), "issue", "left_semi").select("id", F.lit(True).alias("anchored")).distinct()
    own = issue_depths.select(F.col("key").alias("id"), "depth")
    parents = issue_depths.select(F.col("key").alias("parent"), F.lit(True).alias("parent_kept"))
    j = artifacts.join(named, "id", "left").join(own, "id", "left").join(parents, "parent", "left")
    git = F.col("provider") == "git"
    merge = F.col("kind").isin("merge_request", "pull_request")
    issue = (F.col("provider") == "jira") & (F.col("kind") == "issue")
    reason = (
        F.when(F.col("anchored") & git, "business_anchored_git")
        .when(F.col("anchored") & merge, "repository_linked_merge_request")
        .when(F.col("depth") == 0, "direct_jira_reference")
        .when(F.col("depth") > 0, F.concat(F.lit("related_jira_issue:"), F.col("depth").cast("string")))
        .when(F.col("parent_kept"), "retained_parent")
        .when(git | merge, "no_business_anchor")
        .when(issue, "jira_not_referenced_by_repository")
        .when(F.col("parent").isNotNull(), "parent_not_retained")
        .otherwise("unsupported_in_business_scope")
    )
    kept = reason.isin("business_anchored_git", "repository_linked_merge_request", "direct_jira_reference", "retained_parent") | reason.startswith("related_jira_issue")
    return j.select("id", "provider", "kind", F.when(kept, "keep").otherwise("prune").alias("disposition"), reason.alias("reason"))


def symbol_links(changes: DataFrame, symbols: DataFrame, threshold: DataFrame) -> DataFrame:
    """(commit, stable_key) of symbols in files a commit changed, unless it swept through too many.

    ``changes``: (commit, path); ``symbols``: (file_path, stable_key); ``threshold``: one row.
    """
    paths = changes.distinct()
    narrow = paths.groupBy("commit").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(threshold)).filter("n <= threshold").select("commit")
    return paths.join(narrow, "commit", "left_semi").join(symbols, F.col("path") == F.col("file_path")).select("commit", "stable_key").distinct()
