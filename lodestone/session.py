"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without that setting it raises there. Only a
    local master, whose executors are this process, gets a folder of our own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's tables inside the shared folder."""
    return f"{shared_root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, dict]:
    """As :func:`materialise`, with aggregates taken while the rows are written."""
    seen = Observation(name)
    out = materialise(df.observe(seen, *[c.alias(k) for k, c in values.items()]), name)
    return out, seen.get


def together(*tasks: Callable[[], object]) -> list:
    """Results of independent steps whose jobs run side by side, in their order."""
    own = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(own(t)) for t in tasks]]


def release(spark: SparkSession) -> None:
    """Delete every table that was written so far; frames that read them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/lodestone")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class FileStore:
    """Small files in the shared folder through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def write(self, name: str, text: str) -> None:
        """Write through a temporary name and rename, so a reader never sees half a file."""
        part = self._path(f"{self.root}/_{uuid.uuid4().hex}")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.rename(part, self._path(f"{self.root}/{name}")):
            raise OSError(f"{name} is there already or cannot be written")

    def read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        size = self._fs.getFileStatus(path).getLen()
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()[:size]).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    package = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lodestone-ship-")) / "lodestone_package.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(out))
    sc._lodestone_shipped = True
