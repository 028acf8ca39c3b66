"""Queries on analysed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import analyze, scan
from lodestone.session import read, ship
from lodestone.sources.tracker import tree_text


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return analyze.symbols(read(spark, d, "source_files").dropDuplicates(["file_id"]))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of all files with an analyser."""
    return _symbols(spark, d).select("file_id", "name", "canonical", "kind", "start_line", "end_line", "signature")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    return analyze.resolved_calls(_symbols(spark, d))


def code_accesses(spark: SparkSession, d: str) -> DataFrame:
    return analyze.access_edges(_symbols(spark, d))


def code_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Routes that decorators offer, and how many symbols offer each."""
    routes = _symbols(spark, d).select("canonical", F.explode("endpoints").alias("route"))
    return routes.groupBy("route").agg(F.countDistinct("canonical").alias("symbols"))


def duplicate_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Symbols by class of equal shape, names aside: class, members and files."""
    found = _symbols(spark, d).filter("kind <> 'class'")
    return found.groupBy("shape").agg(F.min("canonical").alias("representative"), F.count(F.lit(1)).alias("members"), F.countDistinct("file_id").alias("files"))


def decision_points(spark: SparkSession, d: str) -> DataFrame:
    """Branches, guards, arms, handled errors and fixed values of the Python, Rust and Go files."""
    return scan.decision_points(read(spark, d, "source_files").dropDuplicates(["file_id"]), values=True)


def tree_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of the plain text of every issue description."""
    ship(spark)
    issues = read(spark, d, "jira_issues").select("issue_id", "description").distinct()
    return issues.select("issue_id", F.length(tree_text("description")).alias("chars"))


QUERIES = {f.__name__: f for f in (code_symbols, code_calls, code_accesses, code_endpoints, duplicate_bodies, decision_points, tree_lengths)}
ORACLE: dict[str, str] = {}
