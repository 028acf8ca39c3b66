"""Product documents of a repository: YAML files and Markdown with YAML front matter, and their claims.

The parser of YAML is optional; without it only reading documents raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ship

FRONT = re.compile(r"^---[ \t]*\r?\n(.*?)^---[ \t]*\r?$", re.S | re.M)
# Kinds of documents, the field that holds their text, folders that imply a kind.
BODY = {"feature": "description", "requirement": "statement", "invariant": "statement", "decision": "decision"}
TITLE = {"feature": "name", "decision": "title"}
FOLDERS = {"features": "feature", "requirements": "requirement", "invariants": "invariant", "decisions": "decision"}
RELATION = {"feature": "implements", "requirement": "implements", "invariant": "enforces", "decision": "satisfies"}
LINK = "struct<symbol:string,repair_agent:string,locator:string>"
DOCUMENT = (
    "path string, id string, kind string, title string, body string, status string, visibility string, feature string, implementation_expected boolean, "
    f"anchors array<struct<symbol:string,fingerprint:string,ordinal:int>>, implementation array<{LINK}>, tests array<{LINK}>, content_hash string, error string"
)
_LINKS = pa.list_(pa.struct([("symbol", pa.string()), ("repair_agent", pa.string()), ("locator", pa.string())]))
_ARROW = pa.schema([
    ("path", pa.string()), ("id", pa.string()), ("kind", pa.string()), ("title", pa.string()), ("body", pa.string()), ("status", pa.string()), ("visibility", pa.string()), ("feature", pa.string()), ("implementation_expected", pa.bool_()),
    ("anchors", pa.list_(pa.struct([("symbol", pa.string()), ("fingerprint", pa.string()), ("ordinal", pa.int32())]))), ("implementation", _LINKS), ("tests", _LINKS), ("content_hash", pa.string()), ("error", pa.string()),
])


def front_matter(text: str) -> str:
    """The YAML between the dashes a Markdown document begins with."""
    m = FRONT.match(text.removeprefix("\ufeff"))
    if not m:
        raise ValueError("no front matter")
    return m[1]


def links_of(values, field: str) -> list[dict]:
    """Links given as a name or as a mapping, each with its place."""
    out = []
    for n, v in enumerate(values or []):
        given = v if isinstance(v, dict) else {"symbol": v}
        out.append({"symbol": str(given["symbol"]), "repair_agent": given.get("repair_agent"), "locator": f"{field}[{n}]"})
    return out


def normalised(path: str, text: str) -> dict:
    """A document with its defaults; a missing field that its kind needs raises."""
    import yaml

    raw = yaml.safe_load(front_matter(text) if path.lower().endswith((".md", ".markdown")) else text) or {}
    if not isinstance(raw, dict):
        raise ValueError("no mapping")

    def need(name: str) -> str:
        if raw.get(name) in (None, ""):
            raise ValueError(f"{name} is missing")
        return str(raw[name])

    kind = raw.get("type") or next((k for folder, k in FOLDERS.items() if f"/{folder}/" in f"/{path}"), None)
    if kind not in BODY:
        raise ValueError("type is missing" if kind is None else f"{kind} is no kind")
    body = str(raw.get("description") or "") if kind == "feature" else need(BODY[kind])
    anchors = [{"symbol": a["symbol"], "fingerprint": a["fingerprint"], "ordinal": int(a.get("ordinal", 1))} for a in raw.get("anchors") or []]
    return {
        "path": path, "id": need("id"), "kind": kind, "title": need(TITLE[kind]) if kind in TITLE else body, "body": body, "status": str(raw.get("status") or "active"), "visibility": str(raw.get("visibility") or "internal"),
        "feature": raw.get("feature"), "implementation_expected": bool(raw.get("implementation_expected", True)), "anchors": anchors, "implementation": links_of(raw.get("implementation"), "implementation"),
        "tests": links_of(raw.get("tests"), "tests"), "content_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "error": None,
    }


def parsed(files: DataFrame) -> DataFrame:
    """Documents of (path, text); one that cannot be read has only its path and ``error``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append(normalised(path, text or ""))
                except Exception as e:  # whatever the file holds, it is named
                    rows.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "text").mapInArrow(run, DOCUMENT)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """All documents below a folder; an unreadable one or an id that comes twice raises."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yaml,yml,md}").load(root)
    base = F.lit(root.rstrip("/") + "/")
    docs = parsed(files.select(F.regexp_replace(F.input_file_name(), F.concat(F.lit(r"^.*?"), F.regexp_extract(base, r"([^/]+/)$", 1)), F.lit("")).alias("path"), F.col("value").alias("text")))
    wrong = docs.filter("error is not null").select("path", "error").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['path']}: {r['error']}" for r in wrong))
    twice = docs.groupBy("id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError("ids that come twice: " + ", ".join(r["id"] for r in twice))
    return docs


def provenance(agent: Column) -> Column:
    """(claim_class, source_kind, confidence_bp, producer) of an explicit mapping, or of one an agent repaired."""
    return F.when(agent.isNull(), F.struct(F.lit("assertion").alias("claim_class"), F.lit("documentation").alias("source_kind"), F.lit(10000).alias("confidence_bp"), F.lit("business_context_explicit").alias("producer"))).otherwise(
        F.struct(F.lit("inference").alias("claim_class"), F.lit("llm_inference").alias("source_kind"), F.lit(5500).alias("confidence_bp"), F.concat(F.lit("repair:"), agent).alias("producer"))
    )


def document_claims(docs: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (src, dst, kind, claim_class, source_kind, confidence_bp, producer, locator) of documents,
    and what stayed unresolved (document, symbol, problem).

    ``symbols``: (name, key). A link has to name exactly one symbol; a feature has to be a document.
    """
    relation = F.element_at(F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair]), F.col("kind"))
    own = docs.withColumn("intent", F.concat(F.lit("intent:"), "id"))
    named = own.select("id", "intent", relation.alias("relation"), F.inline("implementation")).unionByName(own.select("id", "intent", F.lit("covered_by").alias("relation"), F.inline("tests")))
    known = symbols.distinct().groupBy(F.col("name").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    j = named.join(known, "symbol", "left")
    covers = F.col("relation") == "covered_by"
    good = j.filter("n = 1").select(
        F.when(covers, F.col("intent")).otherwise(F.col("key")).alias("src"), F.when(covers, F.col("key")).otherwise(F.col("intent")).alias("dst"), F.col("relation").alias("kind"), provenance(F.col("repair_agent")).alias("p"), "locator"
    )
    ids = docs.select(F.col("id").alias("feature"), F.concat(F.lit("intent:"), "id").alias("dst"))
    up = own.filter("feature is not null").join(ids, "feature", "left")
    parent = up.filter("dst is not null").select(F.col("intent").alias("src"), "dst", F.lit("depends_on").alias("kind"), provenance(F.lit(None).cast("string")).alias("p"), F.lit("feature").alias("locator"))
    claims = good.unionByName(parent).select("src", "dst", "kind", "p.claim_class", "p.source_kind", "p.confidence_bp", "p.producer", "locator").distinct()
    problem = F.when(F.col("n").isNull(), "missing").otherwise("ambiguous")
    lost = j.filter("n is null or n > 1").select(F.col("id").alias("document"), "symbol", problem.alias("problem")).unionByName(
        up.filter("dst is null").select(F.col("id").alias("document"), F.concat(F.lit("feature:"), "feature").alias("symbol"), F.lit("missing").alias("problem"))
    )
    return claims, lost.distinct()


def document_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, act) between two readings of the documents: create, version, retire or keep."""
    j = before.select("id", F.col("content_hash").alias("b")).join(after.select("id", F.col("content_hash").alias("a")), "id", "full_outer")
    return j.select("id", F.when(F.col("b").isNull(), "create").when(F.col("a").isNull(), "retire").when(F.col("a") == F.col("b"), "keep").otherwise("version").alias("act"))


def written(id: str, kind: str, title: str, body: str, links: list[str], taken: set[str]) -> tuple[str, str]:
    """Name and YAML text of a new document; an id that is taken raises."""
    if id in taken:
        raise FileExistsError(f"{id} is there already")
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    rows = [f"id: {quote(id)}", f"type: {kind}"]
    if kind in TITLE:
        rows.append(f"{TITLE[kind]}: {quote(title)}")
    rows.append(f"{BODY[kind]}: {quote(body)}")
    if links:
        rows += ["implementation:", *(f"  - {quote(x)}" for x in links)]
    return f"{id}.yaml", "\n".join(rows) + "\n"
