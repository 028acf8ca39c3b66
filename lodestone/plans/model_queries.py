"""Queries on model classes, accesses through them and inferred types, over sources derived from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import types as ty
from lodestone.plans import derived as dv
from lodestone.session import read
from lodestone.sources.graph import load


def _entities(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d).nodes.filter("kind = 'db_entity'").select(F.col("identifier").alias("e"), F.conv(F.substring(F.md5("identifier"), 1, 8), 16, 10).cast("long").alias("file_id"))
    return e.withColumn("model", F.concat(F.lit("M"), F.replace("e", F.lit("_"), F.lit("")))).withColumn("b", dv.bucket(F.col("e"), 3))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A Python module for every table: its model, and functions that use it."""
    e = _entities(spark, d)
    text = F.concat(
        F.lit("class "), "model", F.lit("(Base):\n    __tablename__ = \""), "e", F.lit("\"\n    id = Column(BigInteger, primary_key=True)\n    owner = Column(String(9), ForeignKey(\"users.id\"), nullable=False, unique=True)\n    note = mapped_column(Text, default=\"x\")\n\n"),
        F.lit("def load(session):\n    return session.execute(select("), "model", F.lit(".note))\n\n"),
        F.when(F.col("b") == 0, F.concat(F.lit("def save(session):\n    row = "), "model", F.lit("()\n    session.add(row)\n\n"))).otherwise(F.concat(F.lit("def save(session):\n    session.execute(update("), "model", F.lit(").where(True).values(note=1, owner=2))\n\n"))),
        F.lit("def send(client):\n    a = client.post(f\"{BASE}/v1/{x}\", json={\"k\": 1})\n    return a.json()[\"id\"]\n"),
    )
    return e.select("file_id", text.alias("text"))


def model_tables(spark: SparkSession, d: str) -> DataFrame:
    return models.tables(_sources(spark, d)).drop("file_id")


def model_accesses(spark: SparkSession, d: str) -> DataFrame:
    """Accesses through models, resolved to tables."""
    files = _sources(spark, d)
    found = ty.resolved_accesses(models.accesses(files), models.tables(files))
    return found.select("function", "entity", "kind", F.array_join("columns", ",").alias("columns"))


def model_access_edges(spark: SparkSession, d: str) -> DataFrame:
    files = _sources(spark, d)
    return ty.access_edges(ty.resolved_accesses(models.accesses(files), models.tables(files)))


def schema_edges(spark: SparkSession, d: str) -> DataFrame:
    return ty.schema_edges(models.tables(_sources(spark, d)))


def service_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of HTTP clients with the fields they send and read."""
    found = models.calls(_sources(spark, d))
    return found.groupBy("function", "method", "url", "host", F.array_join("sends", ",").alias("sends"), F.array_join("reads", ",").alias("reads")).agg(F.count(F.lit(1)).alias("n"))


def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose inferred type, a union of up to two models, stands for one table."""
    m = _entities(spark, d).select("model", F.col("e").alias("entity"), dv.bucket(F.col("e"), 40).alias("b"))
    pick = m.groupBy("b").agg(F.min("model").alias("model"))
    s = load(spark, d).nodes.filter("kind = 'code_symbol'").select(F.col("stable_key").alias("symbol"), dv.bucket(F.col("stable_key"), 40).alias("b"), dv.bucket(F.col("stable_key"), 3).alias("c"))
    kind = F.when(F.col("c") == 0, F.concat("model", F.lit(" | None"))).when(F.col("c") == 1, F.col("model")).otherwise(F.concat("model", F.lit(" | Other")))
    return ty.resolved_types(s.join(pick, "b").select("symbol", kind.alias("type")), m)


def import_names(spark: SparkSession, d: str) -> DataFrame:
    """Python files by how many names they import whole modules under."""
    files = read(spark, d, "source_files").filter(F.lower("path").endswith(".py") & F.col("text").isNotNull()).select("file_id", "text").distinct()
    names = F.regexp_extract_all("text", F.lit(r"(?m)^import ([a-z_]+)"), 1)
    return files.groupBy(F.size(F.array_distinct(names)).alias("modules")).agg(F.count(F.lit(1)).alias("files"))


QUERIES = {f.__name__: f for f in (model_tables, model_accesses, model_access_edges, schema_edges, service_calls, inferred_types, import_names)}

from lodestone.plans.graph_queries import GRAPH  # noqa: E402

_E = f"WITH {GRAPH}, t AS (SELECT identifier AS e, 'M' || replace(identifier, '_', '') AS model, {dv.bucket_sql('identifier', 3)} AS b FROM n WHERE kind = 'db_entity')"
_ACC = "a AS (SELECT 'load' AS function, e AS entity, 'read' AS kind, 'note' AS columns FROM t UNION ALL SELECT 'save', e, 'write', CASE b WHEN 0 THEN '' ELSE 'note,owner' END FROM t)"
ORACLE = {
    "model_tables": f"""{_E} SELECT model, lower(e) AS entity, unnest(['id','owner','note']) AS "column", unnest(['BigInteger','String(9)','Text']) AS data_type, unnest([false, false, NULL]) AS nullable, unnest([true, false, false]) AS primary_key, unnest([false, true, false]) AS "unique",
 unnest([NULL,'users',NULL]) AS foreign_table, unnest([NULL,'id',NULL]) AS foreign_column, unnest([NULL,NULL,'''x''']) AS "default" FROM t""",
    "model_accesses": f"{_E}, {_ACC} SELECT function, lower(entity) AS entity, kind, columns FROM a",
    "model_access_edges": f"{_E}, {_ACC} SELECT function, kind, lower(entity) AS entity, columns, 1 AS files FROM a",
    "schema_edges": f"{_E} SELECT lower(e) AS entity, 'id:BigInteger,note:Text,owner:String(9)' AS columns, count(DISTINCT model) AS models FROM t GROUP BY 1",
    "service_calls": f"{_E} SELECT 'send' AS function, 'POST' AS method, '/v1/{{param}}' AS url, 'BASE' AS host, 'k' AS sends, 'id' AS reads, count(*) AS n FROM t",
    "inferred_types": f"""{_E}, p AS (SELECT {dv.bucket_sql('e', 40)} AS b, min(model) AS model FROM t GROUP BY 1) SELECT stable_key AS symbol, t.e AS entity FROM n JOIN p ON p.b = {dv.bucket_sql('stable_key', 40)} JOIN t ON t.model = p.model
 WHERE n.kind = 'code_symbol' AND {dv.bucket_sql('stable_key', 3)} < 2""",
    "import_names": "SELECT len(list_distinct(regexp_extract_all(text, '(?m)^import ([a-z_]+)', 1))) AS modules, count(*) AS files FROM (SELECT DISTINCT file_id, text FROM source_files WHERE lower(path) LIKE '%.py' AND text IS NOT NULL) GROUP BY 1",
}
