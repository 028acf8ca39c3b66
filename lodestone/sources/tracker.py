"""Readers of tracker, repository and document formats, as DataFrame transformations."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

# Tree nodes of the tracker's documents that end a line.
BREAKS = {"paragraph", "heading", "codeBlock", "listItem", "blockquote", "tableRow", "rule", "mediaGroup"}


def flatten_tree(raw: str | None) -> str | None:
    """Plain text of a tracker document tree, blocks on lines of their own; other text as it is."""
    if not raw or not raw.lstrip().startswith("{"):
        return raw
    try:
        tree = json.loads(raw)
    except ValueError:
        return raw
    out: list[str] = []
    todo: list = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, dict):
            kind = node.get("type")
            if kind == "text":
                out.append(str(node.get("text", "")))
            elif kind == "hardBreak":
                out.append("\n")
            else:
                if kind in BREAKS:
                    todo.append("\n")
                todo.extend(reversed([c for c in node.get("content") or [] if isinstance(c, dict)]))
    text = "".join(out)
    return "\n".join(line.rstrip() for line in text.split("\n") if line.strip())


@F.pandas_udf(StringType())
def tree_text(column: pd.Series) -> pd.Series:
    return column.map(flatten_tree, na_action="ignore")


def front_matter(text: Column) -> tuple[Column, Column]:
    """(front matter, body) of a Markdown document; without one the matter is null."""
    pattern = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"
    has = text.rlike(pattern)
    return F.when(has, F.regexp_extract(text, pattern, 1)), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text)


def name_status(log: DataFrame, text: str = "log") -> DataFrame:
    """(op, old_path, new_path) of NUL-separated name-status records; renames take two paths.

    A record is an operation followed by one path, or two for R and C: the position of an
    operation follows from the lengths before it, which one ordered fold adds up.
    """
    fields = F.filter(F.split(F.col(text), "\u0000"), lambda f: f != "")
    empty = F.filter(F.array(F.struct(F.lit("").alias("op"), F.lit("").alias("a"), F.lit("").alias("b"))), lambda x: F.lit(False))
    start = F.struct(empty.alias("done"), F.lit("").alias("op"), F.lit("").alias("a"))

    def step(acc: Column, f: Column) -> Column:
        two = acc["op"].rlike("^[RC]")
        close = lambda a, b: F.concat(acc["done"], F.array(F.struct(acc["op"].alias("op"), a.alias("a"), b.alias("b"))))
        state = lambda done, op, a: F.struct(done.alias("done"), op.alias("op"), a.alias("a"))
        none = F.lit("")
        return (
            F.when(acc["op"] == "", state(acc["done"], f, none))
            .when(two & (acc["a"] == ""), state(acc["done"], acc["op"], f))
            .when(two, state(close(acc["a"], f), none, none))
            .otherwise(state(close(none, f), none, none))
        )

    rows = log.select(F.inline(F.aggregate(fields, start, step)["done"]))
    op = F.when(F.col("op").startswith("A"), "added").when(F.col("op").startswith("D"), "deleted").when(F.col("op").startswith("R"), "renamed").when(F.col("op").startswith("C"), "added").otherwise("modified")
    return rows.select(
        op.alias("op"), F.when(op.isin("deleted", "modified"), F.col("b")).when(op == "renamed", F.col("a")).alias("old_path"), F.when(op != "deleted", F.col("b")).alias("new_path")
    )


def path_allowed(path: Column, include: list[str], exclude: list[str], components: list[str]) -> Column:
    """Whether a path lies below an included prefix, below no excluded one and in no excluded folder."""
    ok = F.lit(True) if not include else F.lit(False)
    for p in include:
        ok = ok | path.startswith(p)
    for p in exclude:
        ok = ok & ~path.startswith(p)
    return ok & (F.size(F.array_intersect(F.split(path, "/"), F.array(*map(F.lit, components)).cast("array<string>"))) == 0)


def degrade_renames(changes: DataFrame, allowed) -> DataFrame:
    """Renames with one side out of scope become a deletion or an addition; changes out of scope go."""
    old, new = allowed(F.col("old_path")), allowed(F.col("new_path"))
    op = (
        F.when(F.col("op") == "renamed", F.when(old & new, "renamed").when(old, "deleted").when(new, "added"))
        .when((F.col("op") == "deleted") & old, "deleted")
        .when(F.col("op").isin("added", "modified") & new, F.col("op"))
    )
    return changes.withColumn("op", op).filter("op is not null").select("op", F.when(F.col("op") != "added", F.col("old_path")).alias("old_path"), F.when(F.col("op") != "deleted", F.col("new_path")).alias("new_path"))


def commit_records(log: DataFrame, text: str = "log") -> DataFrame:
    """(oid, author, date, title, body) of NUL-separated commit records."""
    f = F.split(F.col(text), "\u0000", 5)
    return log.select(F.get(f, F.lit(0)).alias("oid"), F.get(f, F.lit(1)).alias("author"), F.get(f, F.lit(2)).alias("date"), F.substring_index(F.get(f, F.lit(3)), "\n", 1).alias("title"), F.get(f, F.lit(3)).alias("body"))


def openapi_operations(specs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, method, route, operation_id, parameters, security, responses) of OpenAPI JSON documents.

    Local references to parameters are followed; a document that is no JSON object has no rows.
    """
    out = f"{key} {specs.schema[key].dataType.simpleString()}, method string, route string, operation_id string, parameters array<string>, security array<string>, responses array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b[text]):
                rows.extend((k, *op) for op in spec_operations(raw))
            yield pd.DataFrame(rows, columns=[key, "method", "route", "operation_id", "parameters", "security", "responses"])

    return specs.select(key, text).mapInPandas(run, out)


def spec_operations(raw: str | None) -> list[tuple]:
    try:
        spec = json.loads(raw or "")
    except ValueError:
        return []
    if not isinstance(spec, dict) or not isinstance(spec.get("paths"), dict):
        return []

    def follow(value, hops: int = 0):
        while isinstance(value, dict) and str(value.get("$ref", "")).startswith("#/") and hops < 20:
            at = spec
            for part in value["$ref"][2:].split("/"):
                at = at.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
            value, hops = at, hops + 1
        return value

    found = []
    for route, item in spec["paths"].items():
        item = follow(item)
        if not isinstance(item, dict):
            continue
        for method in ("get", "put", "post", "delete", "options", "head", "patch", "trace"):
            op = item.get(method)
            if not isinstance(op, dict):
                continue
            params = {}
            for p in [*(item.get("parameters") or []), *(op.get("parameters") or [])]:
                p = follow(p)
                if isinstance(p, dict) and p.get("name"):
                    params[(p["name"], p.get("in"))] = f"{p.get('in')}:{p['name']}" + ("!" if p.get("required") else "")
            secured = op.get("security", spec.get("security")) or []
            schemes = sorted({f"{n}:[{','.join(sorted(s))}]" if s else n for need in secured if isinstance(need, dict) for n, s in need.items()})
            found.append((method.upper(), route, op.get("operationId"), sorted(params.values()), schemes, sorted(map(str, op.get("responses") or {}))))
    return found


class PagedSource(DataSource):
    """A tracker's pages as a table: ``spark.read.format("paged").option("pages", n).load()``.

    ``fetch``: a function of a page number that returns JSON objects; it is set on a subclass, so
    tests and connectors bring their own transport. One partition a page.
    """

    fetch = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(type(self).fetch, int(self.options.get("pages", "1")))


class _Pages(DataSourceReader):
    def __init__(self, fetch, pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.fetch(partition.value):
            yield partition.value, str(row.get("id")), json.dumps(row, sort_keys=True)
