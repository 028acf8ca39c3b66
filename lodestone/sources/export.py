"""What leaves the engine: manifests for neighbours, diagrams, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.model import INTENTS
from lodestone.operators.graph import both_ways
from lodestone.sources.graph import Graph

NEIGHBOURS = 40


def public_documents(graph: Graph) -> DataFrame:
    """Documents that others may see, in the columns of the manifest."""
    return graph.nodes.filter(F.col("kind").isin(*INTENTS) & (F.col("visibility") == "public")).select("identifier", "kind", "name", "status", "body")


def offered_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints that are not withdrawn, one per repository, method and path: the newest contract."""
    live = endpoints.filter(F.col("withdrawn_at").isNull())
    last = F.max_by(F.struct("handler", "params", "return_type", "framework"), F.struct("published_at", "handler")).alias("e")
    return live.groupBy("source_repo", "method", "path").agg(last).select("source_repo", "method", "path", "e.*")


def write_manifest(graph: Graph, endpoints: DataFrame, path: str) -> None:
    """Both parts as JSON, range-partitioned and sorted, so the same state gives the same files."""
    public_documents(graph).repartitionByRange("identifier").sortWithinPartitions("identifier", "kind").write.mode("overwrite").json(f"{path}/documents")
    offered_endpoints(endpoints).repartitionByRange("source_repo", "method", "path").sortWithinPartitions("source_repo", "method", "path").write.mode("overwrite").json(f"{path}/endpoints")


def mermaid(graph: Graph, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(stable_key, diagram) of each node with its first ``neighbours`` claims; the limit is the feature."""
    around = both_ways(graph.edges.select("src", "dst", "kind", "status", "fingerprint"))
    order = Window.partitionBy("here").orderBy("kind", "there", "fingerprint")
    few = around.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= neighbours)
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit("#quot;")), F.lit('"'))
    line = F.concat(F.lit("  a["), quote("here"), F.lit("] -->|"), F.col("kind"), F.lit("| n"), F.col("n").cast("string"), F.lit("["), quote("there"), F.lit("]"))
    lines = few.groupBy("here").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))  # at most ``neighbours``
    return lines.select(F.col("here").alias("stable_key"), F.concat(F.lit("graph LR\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("diagram"))


def search_rows(graph: Graph) -> DataFrame:
    """Flat rows of a search index: what is shown and what is matched."""
    return graph.nodes.select("stable_key", "kind", "identifier", F.lower(F.concat_ws(" ", "identifier", "name", "file_path")).alias("haystack"))
