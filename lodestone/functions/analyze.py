"""Analysers that turn source text into symbol and access rows."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ddl import name_of
from lodestone.session import ship

HTTP = {"get", "post", "put", "patch", "delete", "head", "options", "request"}
CLIENTS = {"requests", "httpx", "aiohttp", "urllib3", "session", "client"}
SYMBOL = pa.schema([
    ("name", pa.string()), ("canonical", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()),
    ("body_hash", pa.string()), ("shape", pa.string()), ("calls", pa.list_(pa.string())), ("endpoints", pa.list_(pa.string())), ("external", pa.list_(pa.string())), ("reads", pa.list_(pa.string())), ("writes", pa.list_(pa.string())),
])
SYMBOL_SQL = "name string, canonical string, kind string, start_line int, end_line int, signature string, body_hash string, shape string, calls array<string>, endpoints array<string>, external array<string>, reads array<string>, writes array<string>"

TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[\w$.{}]+|[(),;=*]|\S", re.S)
# Words that may stand where a table name is expected.
CLAUSES = {"select", "where", "set", "values", "on", "using", "group", "order", "limit", "join", "left", "right", "inner", "outer", "full", "cross", "lateral", "only", "union", "returning", "as", "with", "into", "from"}


def sql_accesses(sql: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(read or write, entity, columns) of SQL statements; names of common table expressions are none."""
    t = [x for x in TOKEN.findall(sql) if not x.startswith(("--", "/*"))]
    low = [x.lower() for x in t]
    named = {low[i - 1] for i in range(1, len(low) - 1) if low[i] == "as" and low[i + 1] == "(" and i >= 1}
    out: list[tuple[str, str, tuple[str, ...]]] = []

    def entity(i: int) -> str | None:
        while i < len(low) and low[i] in ("only", "lateral", "if", "exists", "table"):
            i += 1
        if i >= len(low) or low[i] in CLAUSES or not re.match(r"[\w\"`]", t[i]) or "{" in t[i]:
            return None
        found = name_of(t[i])
        return None if found in named else found

    def columns(i: int, stop: set[str]) -> tuple[str, ...]:
        found, depth = [], 0
        while i < len(low) and not (depth == 0 and low[i] in stop):
            depth += (low[i] == "(") - (low[i] == ")")
            if depth < 0:
                break
            if i + 1 < len(low) and low[i + 1] == "=" and depth == 0 and re.match(r"[\w\"`]", t[i]):
                found.append(name_of(t[i]).rsplit(".", 1)[-1])
            i += 1
        return tuple(found)

    for i, w in enumerate(low):
        before = low[i - 1] if i else ""
        if w == "insert" and low[i + 1 : i + 2] == ["into"] and (e := entity(i + 2)):
            cols = []
            if low[i + 3 : i + 4] == ["("]:
                k = i + 4
                while k < len(low) and low[k] != ")":
                    if re.match(r"[\w\"`]", t[k]):
                        cols.append(name_of(t[k]))
                    k += 1
            out.append(("write", e, tuple(cols)))
        elif w == "update" and before not in ("for", "do", "on") and (e := entity(i + 1)):
            at = next((k for k in range(i + 1, min(i + 6, len(low))) if low[k] == "set"), None)
            if at is not None:
                out.append(("write", e, columns(at + 1, {"where", "from", "returning", ";"})))
        elif w == "delete" and low[i + 1 : i + 2] == ["from"] and (e := entity(i + 2)):
            out.append(("write", e, ()))
        elif w in ("from", "join") and before != "delete" and (e := entity(i + 1)):
            out.append(("read", e, ()))
    return list(dict.fromkeys(out))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def python_symbols(path: str, text: str) -> list[dict]:
    """Classes, functions and methods with what they call, offer and touch; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    module = re.sub(r"^src\.|\.__init__$", "", re.sub(r"\.py$", "", path).replace("/", "."))
    out: list[dict] = []

    def dotted(node) -> str:
        if isinstance(node, ast.Attribute):
            head = dotted(node.value)
            return f"{head}.{node.attr}" if head else node.attr
        return node.id if isinstance(node, ast.Name) else ""

    def literal(node) -> str | None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        if isinstance(node, ast.JoinedStr):
            parts = [v.value if isinstance(v, ast.Constant) else "{param}" for v in node.values]
            return "".join(map(str, parts))
        return None

    def own(node) -> Iterator[ast.AST]:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield child
                yield from own(child)

    def visit(node, prefix: str, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child, prefix, inside)
                continue
            canonical = f"{prefix}.{child.name}"
            is_class = isinstance(child, ast.ClassDef)
            body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
            calls, outside, reads, writes, offered = [], [], set(), set(), []
            for n in [] if is_class else own(child):
                if isinstance(n, ast.Call):
                    name = dotted(n.func)
                    if name:
                        calls.append(name.rsplit(".", 1)[-1])
                    parts = name.split(".")
                    if len(parts) > 1 and parts[-1] in HTTP and parts[0] in CLIENTS and n.args and (url := literal(n.args[0])):
                        outside.append(f"{parts[-1].upper()} {url}")
                if isinstance(n, ast.Constant) and isinstance(n.value, str) and re.search(r"(?i)\b(?:select|insert|update|delete)\b", n.value):
                    for kind, entity, _ in sql_accesses(n.value):
                        (writes if kind == "write" else reads).add(entity)
            for d in child.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in HTTP | {"route"} and d.args and (route := literal(d.args[0])):
                    offered.append(f"{'GET' if d.func.attr == 'route' else d.func.attr.upper()} {route}")
            kind = "class" if is_class else "test" if child.name.startswith("test") else "method" if inside else "function"
            head = re.match(r"(?:async\s+)?(?:def|class)\s.*?:\s*(?:#.*)?$", body, re.S | re.M)
            out.append({
                "name": child.name, "canonical": canonical, "kind": kind, "start_line": child.lineno, "end_line": child.end_lineno, "signature": re.sub(r"\s+", " ", head[0].rstrip(": ")) if head else None,
                "body_hash": digest(body), "shape": digest(re.sub(r"[ \t\n\r\f]", "", body.replace(child.name, "#", 1))), "calls": sorted(set(calls)), "endpoints": sorted(set(offered)),
                "external": sorted(set(outside)), "reads": sorted(reads), "writes": sorted(writes),
            })
            visit(child, canonical, is_class)

    visit(tree, module, False)
    return out


ANALYSERS: dict[str, Callable[[str, str], list[dict]]] = {}


def register(extension: str, analyser: Callable[[str, str], list[dict]]) -> None:
    """Claim a file extension; a second claim is an error."""
    if extension in ANALYSERS:
        raise ValueError(f"{extension} has an analyser already")
    ANALYSERS[extension] = analyser


register("py", python_symbols)


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of each (file_id, path, text) whose extension has an analyser."""
    ship(files.sparkSession)
    analysers = dict(ANALYSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                analyse = analysers.get((path or "").rsplit(".", 1)[-1].lower())
                for row in analyse(path, text.removeprefix("﻿").replace("\r\n", "\n")) if analyse and text else ():
                    at.append(k)
                    rows.append(row)
            table = pa.Table.from_pylist(rows, schema=SYMBOL).combine_chunks()
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            columns = [table.column(n).combine_chunks() if len(rows) else pa.array([], SYMBOL.field(n).type) for n in SYMBOL.names]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["file_id", *SYMBOL.names])

    return files.select("file_id", "path", "text").filter(F.col("text").isNotNull()).mapInArrow(run, f"file_id bigint, {SYMBOL_SQL}")


def resolved_calls(found: DataFrame) -> DataFrame:
    """(caller, callee) of calls whose name belongs to exactly one function or method."""
    names = found.filter("kind in ('function', 'method')").groupBy("name").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("callee")).filter("n = 1")
    calls = found.select(F.col("canonical").alias("caller"), F.explode("calls").alias("name"))
    return calls.join(names, "name").filter("caller <> callee").select("caller", "callee").distinct()


def access_edges(found: DataFrame) -> DataFrame:
    """(src, kind, dst) of tables that symbols read and write, once each."""
    return (
        found.select(F.col("canonical").alias("src"), F.lit("reads_from").alias("kind"), F.explode("reads").alias("dst"))
        .union(found.select("canonical", F.lit("writes_to"), F.explode("writes")))
        .distinct()
    )
