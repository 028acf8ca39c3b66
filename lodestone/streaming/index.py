"""Continuous indexing: file versions stream in, symbol rows and the newest version come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.analyze import symbols
from lodestone.operators.diff import snapshot_diff

FILES = "file_id long, path string, language string, analysis_version string, content_hash string, commit_seq long, text string"


def file_stream(spark: SparkSession, folder: str, per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(folder)


def newest(rows: DataFrame) -> DataFrame:
    """The last version of each path: a map-side combined aggregate."""
    last = rows.groupBy("path").agg(F.max_by(F.struct("file_id", "content_hash", "commit_seq", "text"), F.struct("commit_seq", "file_id")).alias("v"))
    return last.select("path", "v.*")


class IndexSink:
    """One folder per micro-batch. A batch that is repeated after a failure overwrites its own folder."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        files = newest(batch)
        files.select("file_id", "path", "content_hash", "commit_seq").write.mode("overwrite").parquet(f"{self.root}/files/batch={number}")
        symbols(files).write.mode("overwrite").parquet(f"{self.root}/symbols/batch={number}")

    def files(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.root}/files")
        last = rows.groupBy("path").agg(F.max_by(F.struct("file_id", "content_hash", "commit_seq"), F.struct("commit_seq", "batch")).alias("v"))
        return last.select("path", "v.*")

    def symbols(self, spark: SparkSession) -> DataFrame:
        """Symbols of the newest version of every path; those of replaced versions are left out."""
        current = self.files(spark).select("file_id")
        return spark.read.parquet(f"{self.root}/symbols").drop("batch").join(current, "file_id", "left_semi").dropDuplicates(["file_id", "canonical", "start_line"])


def run(spark: SparkSession, source: str, root: str, checkpoint: str) -> StreamingQuery:
    """Index what is there and stop; the checkpoint remembers which files were read."""
    query = file_stream(spark, source).writeStream.foreachBatch(IndexSink(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths added, modified or deleted between two states of the index."""
    return snapshot_diff(before, after, ["path"], ["content_hash"])


def late_claims(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Claims per hour and status from a stream of snapshot rows; rows later than the watermark are dropped."""
    at = F.col("recorded_at").cast("timestamp")
    rows = events.withColumn("at", at).withWatermark("at", f"{minutes} minutes")
    return rows.groupBy(F.window("at", "1 hour"), F.lower(F.trim("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
