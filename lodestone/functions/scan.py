"""Analysers without a grammar: Rust and Go symbols, and decision points of Python, Rust and Go code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analyze import digest, register, sql_accesses
from lodestone.session import ship

HIDDEN = {
    "rs": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|[bc]?r(\#*)".*?"\1|[bc]?"(?:[^"\\]|\\.)*(?:"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'""", re.S),
    "go": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'""", re.S),
}
RUST_ITEM = re.compile(r"\b(fn|struct|enum|trait|impl|mod)\s+(?:<[^>{]*>\s*)?([A-Za-z_][\w:]*)(?:<[^{;(]*?>)?(?:\s+for\s+([A-Za-z_][\w:]*))?")
GO_FUNC = re.compile(r"^func\s*(?:\(\s*\w*\s*\*?([A-Za-z_]\w*)[^)]*\)\s*)?([A-Za-z_]\w*)", re.M)
GO_TYPE = re.compile(r"^type\s+([A-Za-z_]\w*)", re.M)
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*(?:::<[^>()]*>)?\(")
# Words that a parenthesis may follow without a call.
NO_CALL = {"if", "for", "while", "match", "switch", "return", "fn", "func", "in", "as", "loop", "Some", "Ok", "Err", "None", "Box", "make", "new", "append", "len", "panic", "go", "defer", "select", "case", "range"}


def masked(text: str, ext: str) -> str:
    """The text with strings and comments blanked out, every offset kept."""
    return HIDDEN[ext].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_end(bare: str, at: int) -> int:
    """End of the block whose brace is the next one after ``at``, or of the statement without one."""
    depth, i, n, round_ = 0, at, len(bare), 0
    while i < n:
        c = bare[i]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ -= 1
        elif c == "{" :
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0 and round_ <= 0:
            return i + 1
        i += 1
    return n


def _row(text: str, bare: str, name: str, canonical: str, kind: str, start: int, end: int) -> dict:
    body = text[start:end]
    brace = bare.find("{", start, end)
    head = text[start : brace if brace >= 0 else end].strip().rstrip(";")
    inner = bare[brace:end] if brace >= 0 else ""
    reads, writes = set(), set()
    for literal in re.findall(r'"((?:[^"\\]|\\.)*)"|`([^`]*)`', body):
        sql = literal[0] or literal[1]
        if re.search(r"(?i)\b(?:select|insert|update|delete)\b", sql):
            for what, entity, _ in sql_accesses(sql):
                (writes if what == "write" else reads).add(entity)
    return {
        "name": name, "canonical": canonical, "kind": kind, "start_line": text.count("\n", 0, start) + 1, "end_line": text.count("\n", 0, max(start, end - 1)) + 1, "signature": re.sub(r"\s+", " ", head) or None,
        "body_hash": digest(body), "shape": digest(re.sub(r"[ \t\n\r\f]", "", body.replace(name, "#", 1))), "calls": sorted({c for c in CALL.findall(inner) if c not in NO_CALL}) if kind not in ("class", "module") else [],
        "endpoints": [], "external": [], "reads": sorted(reads), "writes": sorted(writes),
    }


def rust_items(path: str, bare: str) -> Iterator[tuple[re.Match, str, bool, int]]:
    """Items with the path of what holds them, whether that is a type or trait, and their end."""
    module = re.sub(r"^src/|\.rs$|/mod$", "", re.sub(r"\.rs$", "", path)).replace("/", "::")
    scopes: list[tuple[int, str, str]] = []
    for m in RUST_ITEM.finditer(bare):
        word, name, target = m[1], m[2], m[3]
        end = body_end(bare, m.end())
        while scopes and scopes[-1][0] <= m.start():
            scopes.pop()
        yield m, "::".join([module, *(s for _, s, _ in scopes)]), bool(scopes) and scopes[-1][2] in ("impl", "trait"), end
        if word != "struct":
            scopes.append((end, target or name, word))


def rust_symbols(path: str, text: str) -> list[dict]:
    """Structs, enums, traits, functions and methods; a method's path names its type."""
    bare = masked(text, "rs")
    out = []
    for m, prefix, inside, end in rust_items(path, bare):
        word, name = m[1], m[2]
        if word in ("impl", "mod"):
            continue
        before = bare[max(0, bare.rfind("}", 0, m.start())) : m.start()]
        kind = "class" if word != "fn" else "test" if re.search(r"#\[(?:\w+::)?test\]", text[max(0, m.start() - 120) : m.start()]) and "fn" not in before else "method" if inside else "function"
        out.append(_row(text, bare, name, f"{prefix}::{name}", kind, m.start(), end))
    return out


def go_symbols(path: str, text: str) -> list[dict]:
    """Types, functions and methods; the package path is the folder."""
    bare = masked(text, "go")
    package = path.rsplit("/", 1)[0].removeprefix("src/").replace("/", ".") if "/" in path else ""
    join = lambda *parts: ".".join(p for p in parts if p)
    out = [_row(text, bare, m[1], join(package, m[1]), "class", m.start(), body_end(bare, m.end()) if "{" in bare[m.end() : bare.find("\n", m.end()) % (len(bare) + 1)] else m.end()) for m in GO_TYPE.finditer(bare)]
    for m in GO_FUNC.finditer(bare):
        kind = "test" if m[2].startswith("Test") and path.endswith("_test.go") else "method" if m[1] else "function"
        out.append(_row(text, bare, m[2], join(package, m[1], m[2]), kind, m.start(), body_end(bare, m.end())))
    return sorted(out, key=lambda r: r["start_line"])


register("rs", rust_symbols)
register("go", go_symbols)

POINT_SQL = "canonical string, kind string, line int, condition string, fingerprint string, ordinal int, branches int, controlled array<string>, routine boolean"
POINT = pa.schema([("canonical", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("condition", pa.string()), ("fingerprint", pa.string()), ("ordinal", pa.int32()), ("branches", pa.int32()), ("controlled", pa.list_(pa.string())), ("routine", pa.bool_())])


def python_decisions(path: str, text: str, values: bool = False) -> list[dict]:
    """Branches, guards, match arms, defaults and handled errors of Python functions, in order.

    With ``values`` default parameters and literal returns too.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    module = re.sub(r"^src\.", "", re.sub(r"\.py$", "", path).replace("/", "."))
    out: list[dict] = []

    def calls(nodes) -> list[str]:
        found = set()
        for root in nodes:
            for n in ast.walk(root):
                if isinstance(n, ast.Call):
                    f = n.func
                    found.add(f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else "")
        return sorted(found - {""})

    def leaves(body: list) -> bool:
        return bool(body) and isinstance(body[-1], (ast.Return, ast.Raise, ast.Continue, ast.Break))

    def own(node) -> Iterator[ast.AST]:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                yield child
                yield from own(child)

    def visit(node, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}"
                if not isinstance(child, ast.ClassDef):
                    function(child, name)
                visit(child, name)
            else:
                visit(child, prefix)

    def function(node, canonical: str) -> None:
        seen: dict[str, int] = {}

        def add(kind: str, at, condition: str, branches: int, controlled: list[str], routine: bool) -> None:
            mark = digest(f"{kind}:{re.sub(r'\s', '', condition)}")[:16]
            seen[mark] = seen.get(mark, 0) + 1
            out.append({"canonical": canonical, "kind": kind, "line": at.lineno, "condition": condition, "fingerprint": mark, "ordinal": seen[mark], "branches": branches, "controlled": controlled, "routine": routine})

        if values:
            given = node.args.defaults + [d for d in node.args.kw_defaults if d]
            for d in sorted(given, key=lambda d: (d.lineno, d.col_offset)):
                add("default_value", d, ast.unparse(d), 1, [], False)
        for n in own(node):
            if values and isinstance(n, ast.Return) and (isinstance(n.value, ast.JoinedStr) or (isinstance(n.value, ast.Constant) and n.value.value is not ...)):
                add("literal_return", n, ast.unparse(n.value), 1, [], False)
            if isinstance(n, ast.If):
                test = ast.unparse(n.test)
                routine = test.startswith(("isinstance(", "not isinstance(")) or (leaves(n.body) and len(n.body) == 1 and re.fullmatch(r"(?:not )?\w+|\w+ is (?:not )?None", test) is not None and not calls(n.body))
                add("guard" if leaves(n.body) and not n.orelse else "branch", n, test, 1 + bool(n.orelse), calls([*n.body, *n.orelse]), routine)
            elif isinstance(n, ast.IfExp):
                add("branch", n, ast.unparse(n.test), 2, calls([n.body, n.orelse]), False)
            elif isinstance(n, ast.Match):
                for case in n.cases:
                    out_at = case.body[0] if case.body else n
                    add("arm", out_at, ast.unparse(case.pattern) + (f" if {ast.unparse(case.guard)}" if case.guard else ""), len(n.cases), calls(case.body), False)
            elif isinstance(n, ast.ExceptHandler):
                add("error", n, ast.unparse(n.type) if n.type else "", 1, calls(n.body), len(n.body) == 1 and isinstance(n.body[0], (ast.Raise, ast.Pass)))
            elif isinstance(n, ast.BoolOp) and isinstance(n.op, ast.Or) and isinstance(n.values[-1], ast.Constant):
                add("default_value", n, ast.unparse(n), 1, [], False)

    visit(tree, module)
    return out


def decision_points(files: DataFrame, values: bool = False) -> DataFrame:
    """Decision points of the Python, Rust and Go files among (file_id, path, text).

    ``values`` adds the fixed values of Python, default parameters and literal returns.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.functions.decisions import source_decisions

        for batch in batches:
            at, rows = [], []
            for k, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                text, ext = text.removeprefix("﻿").replace("\r\n", "\n"), path.lower().rsplit(".", 1)[-1]
                for row in python_decisions(path, text, values) if ext == "py" else source_decisions(path, text, ext):
                    at.append(k)
                    rows.append(row)
            table = pa.Table.from_pylist(rows, schema=POINT).combine_chunks()
            columns = [table.column(n).combine_chunks() if rows else pa.array([], POINT.field(n).type) for n in POINT.names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["file_id", *POINT.names])

    source = files.select("file_id", "path", "text").filter(F.col("text").isNotNull() & F.lower("path").rlike(r"\.(py|rs|go)$"))
    return source.mapInArrow(run, f"file_id bigint, {POINT_SQL}")
