"""Python sources read for what they say about tables and services: model classes, access through them,
thin HTTP wrappers, the fields of requests and responses, and imports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

# Calls that declare a column, verbs of access, calls of a session, clients.
COLUMN_CALLS = {"Column", "mapped_column"}
VERBS = {"select": "read", "insert": "write", "update": "write", "delete": "write"}
SESSION = {"add": "write", "add_all": "write", "merge": "write", "delete": "write", "get": "read", "query": "read", "scalar": "read"}
HTTP = {"get", "post", "put", "patch", "delete", "head", "options"}
CLIENTS = {"requests", "httpx", "session", "client"}

TABLE = pa.schema([("model", pa.string()), ("entity", pa.string()), ("column", pa.string()), ("data_type", pa.string()), ("nullable", pa.bool_()), ("primary_key", pa.bool_()), ("unique", pa.bool_()), ("foreign_table", pa.string()), ("foreign_column", pa.string()), ("default", pa.string())])
TABLE_SQL = "model string, entity string, column string, data_type string, nullable boolean, primary_key boolean, unique boolean, foreign_table string, foreign_column string, default string"
ACCESS = pa.schema([("function", pa.string()), ("model", pa.string()), ("kind", pa.string()), ("columns", pa.list_(pa.string()))])
ACCESS_SQL = "function string, model string, kind string, columns array<string>"
CALL = pa.schema([("function", pa.string()), ("method", pa.string()), ("url", pa.string()), ("host", pa.string()), ("sends", pa.list_(pa.string())), ("reads", pa.list_(pa.string())), ("wrapper", pa.string())])
CALL_SQL = "function string, method string, url string, host string, sends array<string>, reads array<string>, wrapper string"


def dotted(node: ast.AST | None) -> str:
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return node.id if isinstance(node, ast.Name) else ""


def last(node: ast.AST | None) -> str:
    return dotted(node).rsplit(".", 1)[-1]


def imports_of(tree: ast.Module) -> dict[str, str]:
    """What each imported name stands for."""
    out = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                out[a.asname or a.name] = f"{n.module}.{a.name}" if n.module else a.name
    return out


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def flag(call: ast.Call, name: str) -> bool | None:
    value = next((k.value for k in call.keywords if k.arg == name), None)
    return value.value if isinstance(value, ast.Constant) and isinstance(value.value, bool) else None


def column_of(name: str, call: ast.Call) -> dict:
    """A column from the arguments that declare it; what they do not say stays undetermined."""
    args = list(call.args)
    if args and (given := text_of(args[0])) is not None:
        name, args = given, args[1:]
    kind, foreign = None, None
    for a in args:
        inner = a.func if isinstance(a, ast.Call) else a
        if last(inner) == "ForeignKey" and isinstance(a, ast.Call):
            foreign = text_of(a.args[0]) if a.args else None
        elif kind is None and dotted(inner):
            kind = ast.unparse(a)
    default = next((ast.unparse(k.value) for k in call.keywords if k.arg in ("default", "server_default")), None)
    key = bool(flag(call, "primary_key"))
    table, _, column = (foreign or "").rpartition(".")
    return {
        "column": name, "data_type": kind, "nullable": False if key else flag(call, "nullable"), "primary_key": key, "unique": bool(flag(call, "unique")), "foreign_table": (table or column) or None if foreign else None,
        "foreign_column": column if foreign and table else None, "default": default,
    }


def model_tables(text: str) -> list[dict]:
    """Columns of every class that names its table as a literal; a class without columns has one empty row."""
    out = []
    for cls in (n for n in ast.walk(_tree(text)) if isinstance(n, ast.ClassDef)):
        entity, columns = None, []
        for s in cls.body:
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if not isinstance(target, ast.Name):
                continue
            if target.id == "__tablename__":
                entity = text_of(s.value)
            elif isinstance(s.value, ast.Call) and last(s.value.func) in COLUMN_CALLS:
                columns.append(column_of(target.id, s.value))
        if entity:
            out += [{"model": cls.name, "entity": entity.lower(), **c} for c in columns or [{}]]
    return out


def _tree(text: str) -> ast.Module:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return ast.Module([], [])


def functions(tree: ast.Module, prefix: str = "") -> Iterator[tuple[str, ast.AST]]:
    """Every function with its path inside the module."""
    for n in ast.iter_child_nodes(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{prefix}{n.name}"
            if not isinstance(n, ast.ClassDef):
                yield name, n
            yield from functions(n, f"{name}.")
        else:
            yield from functions(n, prefix)


def own(node: ast.AST) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child
            yield from own(child)


def value_columns(call: ast.Call) -> list[str] | None:
    """Columns that ``.values(...)`` sets; null for a payload that is not all literal."""
    if any(k.arg is None for k in call.keywords):
        return None
    names = [k.arg for k in call.keywords]
    for a in call.args:
        if not isinstance(a, ast.Dict) or any(text_of(k) is None for k in a.keys):
            return None
        names += [text_of(k) for k in a.keys]
    return sorted(set(names))


def model_accesses(text: str) -> list[dict]:
    """Reads and writes through model classes: verb expressions, and what goes through a session.

    A name a session takes stands for the class that the function made it from, once.
    """
    out = []
    for name, f in functions(_tree(text)):
        made: dict[str, str | None] = {}
        for n in own(f):
            if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                own_class = last(n.value.func) if isinstance(n.value, ast.Call) and last(n.value.func)[:1].isupper() else None
                made[n.targets[0].id] = own_class if n.targets[0].id not in made else None
        found: dict[tuple[str, str], set[str]] = {}
        values: dict[int, list[list[str] | None]] = {}
        for n in own(f):
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "values":
                inner = n.func.value
                while isinstance(inner, ast.Call) and isinstance(inner.func, ast.Attribute):
                    inner = inner.func.value
                values.setdefault(id(inner), []).append(value_columns(n))

        def model(node: ast.AST) -> str | None:
            if isinstance(node, ast.Call):
                return model(node.func)
            if isinstance(node, ast.Attribute) and node.attr[:1].islower():
                return model(node.value)
            word = last(node)
            return word if word[:1].isupper() else made.get(word)

        for n in own(f):
            if not isinstance(n, ast.Call):
                continue
            verb, holder = last(n.func), dotted(n.func.value) if isinstance(n.func, ast.Attribute) else ""
            if verb in VERBS and isinstance(n.func, ast.Name):
                for a in n.args:
                    if m := model(a):
                        columns = {a.attr} if isinstance(a, ast.Attribute) and a.attr[:1].islower() else set()
                        given = values.get(id(n), [])
                        found.setdefault((m, VERBS[verb]), set()).update(columns if None in given else columns.union(*given))
            elif verb in SESSION and holder.rsplit(".", 1)[-1].lower() in ("session", "db", "s"):
                args = [x for a in n.args[:1] for x in (a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a])]
                for a in args:
                    if (m := model(a)) and not (isinstance(a, ast.Call) and last(a.func) in VERBS):
                        found.setdefault((m, SESSION[verb]), set())
        out += [{"function": name, "model": m, "kind": k, "columns": sorted(c)} for (m, k), c in sorted(found.items())]
    return out


def url_of(node: ast.AST | None) -> tuple[str | None, str | None]:
    """(url or path, host expression) of a literal or f-string; parts that vary are ``{param}``.

    Where the string begins with one expression and a path, that expression is the host. A string
    that varies in its host otherwise, or is nothing but an expression, has no url.
    """
    if (literal := text_of(node)) is not None:
        return literal, None
    if not isinstance(node, ast.JoinedStr) or not node.values:
        return None, None
    parts = list(node.values)
    host = None
    if isinstance(parts[0], ast.FormattedValue):
        if len(parts) < 2 or not str(text_of(parts[1]) or "").startswith("/"):
            return None, None
        host, parts = ast.unparse(parts[0].value), parts[1:]
    shape = "".join(text_of(p) if isinstance(p, ast.Constant) else "{param}" for p in parts)
    if host is None and re.match(r"https?://[^/]*\{param\}", shape):
        return None, None
    return shape, host


def keys_of(node: ast.AST | None) -> list[str]:
    return sorted({t for k in node.keys if (t := text_of(k))}) if isinstance(node, ast.Dict) else []


def http_calls(text: str) -> list[dict]:
    """Calls of an HTTP client with what they send and read, also through thin wrappers of the module.

    A wrapper is a function that hands one of its parameters to a client as the url; its callers
    with a literal make the call. What is read are keys of the decoded answer, taken at once or
    from a local that is assigned once.
    """
    tree = _tree(text)
    found, wrappers = [], {}

    def client(n: ast.AST) -> str | None:
        if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in HTTP):
            return None
        return n.func.attr.upper() if dotted(n.func.value).split(".")[-1].lower() in CLIENTS else None

    every = list(functions(tree))
    for name, f in every:
        params = [a.arg for a in f.args.args]
        for n in own(f):
            if (method := client(n)) and n.args and isinstance(n.args[0], ast.Name) and n.args[0].id in params:
                wrappers[name.rsplit(".", 1)[-1]] = (method, params.index(n.args[0].id) - (params[:1] == ["self"]))
    for name, f in every:
        times: dict[str, int] = {}
        for n in own(f):
            if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name):
                times[n.targets[0].id] = times.get(n.targets[0].id, 0) + 1
        for n in own(f):
            method, wrapper, url = client(n), None, None
            if method and n.args:
                url = n.args[0]
            elif isinstance(n, ast.Call) and last(n.func) in wrappers and last(n.func) != name.rsplit(".", 1)[-1]:
                wrapper = last(n.func)
                method, at = wrappers[wrapper]
                url = n.args[at] if 0 <= at < len(n.args) else None
            path, host = url_of(url)
            if path is None:
                continue
            sends = sorted({k for w in n.keywords if w.arg in ("json", "data") for k in keys_of(w.value)})
            reads = set()
            names = {t.targets[0].id for t in own(f) if isinstance(t, ast.Assign) and t.value is n and isinstance(t.targets[0], ast.Name) and times[t.targets[0].id] == 1}
            decoded = {t.targets[0].id for t in own(f) if isinstance(t, ast.Assign) and _json_of(t.value, n, names) and isinstance(t.targets[0], ast.Name) and times[t.targets[0].id] == 1}
            for s in own(f):
                if isinstance(s, ast.Subscript) and (key := text_of(s.slice)) and (_json_of(s.value, n, names) or (isinstance(s.value, ast.Name) and s.value.id in decoded)):
                    reads.add(key)
            found.append({"function": name, "method": method, "url": path, "host": host, "sends": sends, "reads": sorted(reads), "wrapper": wrapper})
    return found


def _json_of(node: ast.AST, call: ast.Call, names: set[str]) -> bool:
    """Whether a node decodes the answer of a call."""
    if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "json"):
        return False
    return node.func.value is call or (isinstance(node.func.value, ast.Name) and node.func.value.id in names)


def _over(files: DataFrame, read, schema: pa.Schema, sql: str) -> DataFrame:
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for row in read(text.removeprefix("﻿").replace("\r\n", "\n")):
                    at.append(k)
                    rows.append(row)
            table = pa.Table.from_pylist(rows, schema=schema).combine_chunks()
            columns = [table.column(n).combine_chunks() if rows else pa.array([], schema.field(n).type) for n in schema.names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["file_id", *schema.names])

    return files.select("file_id", "text").filter(F.col("text").isNotNull()).mapInArrow(run, f"file_id bigint, {sql}")


def tables(files: DataFrame) -> DataFrame:
    """Columns of the model classes in Python sources (file_id, text)."""
    return _over(files, model_tables, TABLE, TABLE_SQL)


def accesses(files: DataFrame) -> DataFrame:
    """Reads and writes through model classes in Python sources (file_id, text)."""
    return _over(files, model_accesses, ACCESS, ACCESS_SQL)


def calls(files: DataFrame) -> DataFrame:
    """Calls of HTTP clients in Python sources (file_id, text)."""
    return _over(files, http_calls, CALL, CALL_SQL)
