"""Accesses through classes, resolved to tables; types that a server infers, as a layer of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved_accesses(found: DataFrame, models: DataFrame) -> DataFrame:
    """(file_id, function, entity, kind, columns) of accesses whose class is known.

    ``models``: (file_id, model, entity). A class of the same file comes first, else one whose name
    stands for exactly one table everywhere.
    """
    here = models.select("file_id", "model", F.col("entity").alias("own")).distinct().groupBy("file_id", "model").agg(F.count(F.lit(1)).alias("k"), F.min("own").alias("own")).filter("k = 1").drop("k")
    once = models.groupBy("model").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("any")).filter("n = 1").drop("n")
    j = found.join(here, ["file_id", "model"], "left").join(once, "model", "left")
    return j.select("file_id", "function", F.coalesce("own", "any").alias("entity"), "kind", "columns").filter("entity is not null")


def access_edges(resolved: DataFrame) -> DataFrame:
    """(function, kind, entity, columns, files) of every pair: the columns and files of its sites, sorted."""
    flat = resolved.withColumn("column", F.explode_outer("columns"))
    return flat.groupBy("function", "kind", "entity").agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"), F.countDistinct("file_id").alias("files")
    )


def schema_edges(tables: DataFrame) -> DataFrame:
    """(entity, columns, models): the distinct ``name:type`` of each declared table and the classes that declare it."""
    return tables.groupBy("entity").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("column").isNotNull(), F.concat("column", F.lit(":"), F.coalesce("data_type", F.lit("?")))))), ",").alias("columns"), F.countDistinct("model").alias("models")
    )


def inferred(probes: DataFrame, oracle: Callable[[], Callable[[str, int], str | None]]) -> DataFrame:
    """Probes (path, offset, ...) with ``type``: one server of types a partition, started by ``oracle``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = oracle()
        for frame in frames:
            yield frame.assign(type=[ask(p, int(o)) for p, o in zip(frame["path"], frame["offset"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in probes.schema)
    return probes.mapInPandas(run, f"{schema}, type string")


def resolved_types(types: DataFrame, models: DataFrame) -> DataFrame:
    """(symbol, entity) of types whose every member names a class of one and the same table.

    ``types``: (symbol, type); members are parted by ``|``, ``None`` is none of them.
    """
    members = types.select("symbol", "type", F.explode(F.array_distinct(F.filter(F.transform(F.split("type", r"\|"), lambda t: F.trim(t)), lambda t: ~t.isin("None", "")))).alias("model"))
    once = models.groupBy("model").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).filter("n = 1").drop("n")
    j = members.join(once, "model", "left").groupBy("symbol", "type").agg(F.count(F.lit(1)).alias("all"), F.count("entity").alias("known"), F.countDistinct("entity").alias("tables"), F.min("entity").alias("entity"))
    return j.filter((F.col("all") == F.col("known")) & (F.col("tables") == 1)).select("symbol", "entity").distinct()


def next_layer(before: DataFrame, now: DataFrame, degraded: bool) -> DataFrame:
    """The layer of inferred accesses: the new one, unless its run was degraded; then the old one stays."""
    return before if degraded else now
