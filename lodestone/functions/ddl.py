"""Schema statements of SQL text, as rows of operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.session import ship

TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|[\w$.]+|[(),;]|[^\s\w]""", re.S)
# Words that begin a column constraint or a table constraint.
COLUMN_STOPS = {"not", "null", "default", "primary", "unique", "references", "check", "constraint", "generated", "collate", "auto_increment"}
TABLE_CONSTRAINTS = {"primary", "unique", "foreign", "check", "constraint", "exclude", "index", "key"}
FIELDS = ("entity", "op", "column", "data_type", "nullable", "primary_key", "unique", "foreign_key", "default", "new_name", "position")
SCHEMA = "entity string, op string, column string, data_type string, nullable boolean, primary_key boolean, unique boolean, foreign_key string, default string, new_name string, position int"


def up_section(text: str) -> str:
    """The part between ``-- +goose Up`` and ``-- +goose Down``, or the whole text without such marks."""
    m = re.search(r"-- \+goose Up[^\n]*\n(.*?)(?=-- \+goose Down|\Z)", text, re.S)
    return m[1] if m else text


def statements(text: str) -> list[list[str]]:
    """Tokens of each statement, comments left out; quotes and parentheses hide no semicolon."""
    out, now = [], []
    for t in TOKEN.findall(text):
        if t.startswith(("--", "/*")):
            continue
        if t == ";":
            if now:
                out.append(now)
            now = []
        else:
            now.append(t)
    return out + ([now] if now else [])


def name_of(token: str) -> str:
    return ".".join(p.strip('"`[]') for p in token.split(".")).lower()


def top_level(tokens: list[str]) -> list[list[str]]:
    """Split at commas outside parentheses."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def balanced(tokens: list[str], at: int) -> tuple[list[str], int]:
    """What stands inside the parenthesis at ``at``, and the index after it."""
    depth, i = 0, at
    while i < len(tokens):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        i += 1
        if depth == 0:
            return tokens[at + 1 : i - 1], i
    return tokens[at + 1 :], len(tokens)


def column(tokens: list[str]) -> dict:
    """One column clause."""
    low = [t.lower() for t in tokens]
    i, kind = 1, ""
    while i < len(tokens) and low[i] not in COLUMN_STOPS:
        if tokens[i] == "(":
            inner, i = balanced(tokens, i)
            kind += "(" + "".join(inner) + ")"
        else:
            kind += (" " if kind and tokens[i] not in ",()" else "") + low[i]
            i += 1
    out = {"column": name_of(tokens[0]), "data_type": kind or None, "nullable": None, "primary_key": False, "unique": False, "foreign_key": None, "default": None}
    while i < len(tokens):
        pair = low[i : i + 2]
        if pair == ["not", "null"]:
            out["nullable"] = False
            i += 1
        elif low[i] == "null":
            out["nullable"] = True
        elif pair == ["primary", "key"]:
            out["primary_key"], out["nullable"] = True, False
            i += 1
        elif low[i] == "unique":
            out["unique"] = True
        elif low[i] == "references" and i + 1 < len(tokens):
            out["foreign_key"] = name_of(tokens[i + 1])
            i += 1
            if tokens[i + 1 : i + 2] == ["("]:
                inner, after = balanced(tokens, i + 1)
                out["foreign_key"] += "." + name_of("".join(inner))
                i = after - 1
        elif low[i] == "default" and i + 1 < len(tokens):
            value = tokens[i + 1]
            i += 1
            if tokens[i + 1 : i + 2] == ["("]:
                inner, after = balanced(tokens, i + 1)
                value += "(" + "".join(inner) + ")"
                i = after - 1
            out["default"] = value
        elif tokens[i] == "(":
            i = balanced(tokens, i)[1] - 1
        i += 1
    return out


def parse(tokens: list[str]) -> list[dict]:
    """Operations of one statement; a statement of another kind has none."""
    low = [t.lower() for t in tokens]

    def skip(i: int, *names: str) -> int:
        while i < len(low) and low[i] in names:
            i += 1
        return i

    if low[:1] == ["create"]:
        i = skip(1, "global", "local", "temporary", "temp", "unlogged", "or", "replace", "unique")
        if low[i : i + 1] == ["index"]:
            at = low.index("on") if "on" in low else None
            name = tokens[skip(i + 1, "concurrently", "if", "not", "exists")] if at else ""
            return [{"entity": name_of(tokens[at + 1]), "op": "create_index", "column": name_of(name), "unique": "unique" in low[:i]}] if at and at + 1 < len(tokens) else []
        if low[i : i + 1] != ["table"]:
            return []
        i = skip(i + 1, "if", "not", "exists")
        if i >= len(tokens):
            return []
        entity, out = name_of(tokens[i]), []
        out.append({"entity": entity, "op": "create"})
        if "(" not in tokens[i:]:
            return out
        columns: dict[str, dict] = {}
        for part in top_level(balanced(tokens, tokens.index("(", i))[0]):
            first = part[0].lower()
            if first not in TABLE_CONSTRAINTS:
                c = column(part)
                columns[c["column"]] = c
                continue
            words = [w.lower() for w in part]
            if words[0] == "constraint":
                part, words = part[2:], words[2:]
            if "(" not in part:
                continue
            named = [name_of(p[0]) for p in top_level(balanced(part, part.index("("))[0])]
            for n in named:
                if n not in columns:
                    continue
                if words[:1] == ["primary"]:
                    columns[n]["primary_key"], columns[n]["nullable"] = True, False
                elif words[:1] == ["unique"] and len(named) == 1:
                    columns[n]["unique"] = True
                elif words[:1] == ["foreign"] and "references" in words:
                    columns[n]["foreign_key"] = name_of(part[words.index("references") + 1])
        return out + [{"entity": entity, "op": "add"} | c for c in columns.values()]
    if low[:2] == ["drop", "table"]:
        i = skip(2, "if", "exists")
        return [{"entity": name_of(p[0]), "op": "drop_table"} for p in top_level(tokens[i:])]
    if low[:2] == ["alter", "table"]:
        i = skip(2, "if", "exists", "only")
        entity, out = name_of(tokens[i]), []
        for part in top_level(tokens[i + 1 :]):
            w = [x.lower() for x in part]
            if w[0] == "add" and len(w) > 1 and w[1] not in TABLE_CONSTRAINTS:
                k = 1
                while k < len(w) and w[k] in ("column", "if", "not", "exists"):
                    k += 1
                out.append({"entity": entity, "op": "add"} | column(part[k:]) if k < len(part) else {"entity": entity, "op": "other"})
            elif w[0] == "drop" and len(w) > 1 and w[1] != "constraint":
                k = 1
                while k < len(w) - 1 and w[k] in ("column", "if", "exists"):
                    k += 1
                out.append({"entity": entity, "op": "drop", "column": name_of(part[k])})
            elif w[0] == "rename" and "to" in w:
                to = w.index("to")
                olds = [x for x in part[1:to] if x.lower() != "column"]
                out.append({"entity": entity, "op": "rename" if olds else "rename_table", "column": name_of(olds[0]) if olds else None, "new_name": name_of(part[to + 1])})
            elif w[0] == "alter" and len(w) > 2:
                k = 2 if w[1] == "column" else 1
                rest = w[k + 1 :]
                change = {"entity": entity, "op": "alter", "column": name_of(part[k])}
                if "type" in rest:
                    change["data_type"] = " ".join(rest[rest.index("type") + 1 :]) or None
                if rest[1:3] == ["not", "null"]:
                    change["nullable"] = rest[0] == "drop"
                if rest[:2] == ["set", "default"]:
                    change["default"] = "".join(part[k + 3 :])
                out.append(change)
        return out
    return []


def operations(files: DataFrame, key: str, text: str) -> DataFrame:
    """One row per schema operation of each text, in order (position); null texts have none."""
    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, source in enumerate(batch.column(1).to_pylist()):
                found = [o for s in statements(up_section(source or "")) for o in parse(s)]
                for n, o in enumerate(found):
                    at.append(k)
                    rows.append({f: o.get(f) for f in FIELDS} | {"position": n})
            table = pa.Table.from_pylist(rows, schema=pa.schema([
                ("entity", pa.string()), ("op", pa.string()), ("column", pa.string()), ("data_type", pa.string()), ("nullable", pa.bool_()), ("primary_key", pa.bool_()),
                ("unique", pa.bool_()), ("foreign_key", pa.string()), ("default", pa.string()), ("new_name", pa.string()), ("position", pa.int32()),
            ])).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[table.column(f).combine_chunks() for f in FIELDS]], names=[key, *FIELDS])

    return files.select(key, text).mapInArrow(run, f"{key} {kind}, {SCHEMA}")
