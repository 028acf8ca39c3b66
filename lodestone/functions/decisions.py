"""Decision points of Rust and Go code, on masked text by brace matching.

Like the reference: a closure belongs to no point of the function around it, what stands in a
Rust macro call is no syntax, and an ``if`` is a guard when its block ends in a return.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodestone.functions.analyze import digest
from lodestone.functions.scan import CALL, GO_FUNC, HIDDEN, NO_CALL, body_end, masked, rust_items

MACRO = re.compile(r"\b(?:macro_rules!\s*\w+|\w+!)\s*[(\[{]")
CLOSURE = re.compile(r"(?:(?<=[(,=;{\[&])|(?<==>)|\bmove\b|\breturn\b|\basync\b)\s*(\|[^|;{}]*\|)(?!\|)(?!\s*=>)")
FUNC_LITERAL = re.compile(r"\bfunc\s*\(")
LITERAL = re.compile(r"""(?:true|false|nil|[bc]?r?\#*".*"\#*|`[^`]*`|(?:0[xobXOB][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)_?(?:[iuf](?:8|16|32|64|128|size))?)""", re.S)


def blank(code: str, start: int, end: int) -> str:
    return code[:start] + re.sub(r"[^\n]", " ", code[start:end]) + code[end:]


def closing(code: str, at: int) -> int:
    """Offset behind the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] in "([{") - (code[i] in ")]}")
        if depth <= 0:
            return i + 1
    return len(code)


def level(code: str, start: int, end: int) -> Iterator[int]:
    """Offsets within [start, end) that stand in no bracket; of a bracket only its opening."""
    i = start
    while i < end:
        yield i
        i = closing(code, i) if code[i] in "([{" else i + 1


def block_of(code: str, at: int, end: int) -> int:
    """The brace of the block after a head that may hold blocks itself; -1 without one."""
    last = at
    for i in level(code, at, end):
        if code[i] in ";)]}" and code[i] != ";":
            return -1
        if code[i] == "{":
            if not re.search(r"\b(?:match|unsafe|if|loop|async|else|struct|interface)\b(?!.*\b(?:match|unsafe|if|loop|async|else)\b.*\{)", code[last:i], re.S):
                return i
            last = closing(code, i)
    return -1


def calls(code: str, *spans: tuple[int, int]) -> list[str]:
    return sorted({c for a, b in spans for c in CALL.findall(code[a:b]) if c not in NO_CALL})


def last_statement(code: str, start: int, end: int, ext: str) -> str:
    """The last statement of a block's inside."""
    at, before = start, ""
    for i in level(code, start, end):
        c = code[i]
        if ext == "go":
            cut = c == ";" or (c == "\n" and (before[-2:] in ("++", "--") or before[-1:] not in tuple("+-*/%&|^<>=!,.")))
            behind = i + 1
        else:
            behind = closing(code, i) if c == "{" else i + 1
            cut = c == ";" or (c == "{" and re.match(r"\s*(?!else\b|as\b)[\w#&*]", code[behind:end]) is not None)
        if cut and code[behind:end].strip():
            at = behind
        if not c.isspace():
            before = (before + c)[-2:]
    return code[at:end].strip()


def operand(code: str, end: int) -> int:
    """Start of the postfix expression that ends at ``end``."""
    i = end
    while i > 0:
        while i > 0 and code[i - 1].isspace():
            i -= 1
        c = code[i - 1] if i else ""
        if c == "?":
            i -= 1
            continue
        if c and c in ")]}>":
            depth, shut, opened = 0, ")]}" + (">" if c == ">" else ""), "([{" + ("<" if c == ">" else "")
            while i > 0:
                i -= 1
                depth += (code[i] in shut) - (code[i] in opened)
                if depth == 0:
                    break
        had = re.search(r"(?:\w|!(?=[(\[{]))+\Z", code[:i])
        if had and not re.fullmatch(r"return|match|in|if|else|await!", had[0]):
            i = had.start()
        elif c and c not in ")]}>" or not c:
            return i
        elif code[:i].rstrip().endswith(("?", ")", "]", ">")):
            continue
        link = re.search(r"(?:\.|::)\s*\Z", code[:i])
        if not link:
            return i
        i = link.start()
    return i


def points(text: str, plain: str, code: str, start: int, end: int, ext: str) -> list[tuple]:
    """(start, end, kind, condition, branches, calls, routine) of one function's blanked code.

    ``plain`` is the text without comments, where arms of strings can be seen.
    """
    out, patterns = [], []
    said = lambda a, b: text[a:b].strip()
    for m in re.compile(r"\b(?:match)\b" if ext == "rs" else r"\b(?:switch|select)\b").finditer(code, start, end):
        brace = block_of(code, m.end(), end)
        if brace < 0:
            continue
        inner, stop, arms = brace + 1, closing(code, brace) - 1, []
        if ext == "rs":
            at = inner
            while at < stop:
                arrow = next((i for i in level(code, at, stop) if code.startswith("=>", i)), -1)
                if arrow < 0:
                    break
                first = at + re.match(r"[\s,]*(?:#\[[^\]]*\]\s*)*\|?\s*", plain[at:arrow]).end()
                value = arrow + 2 + len(code[arrow + 2 : stop]) - len(code[arrow + 2 : stop].lstrip())
                if code.startswith("{", value):
                    behind = closing(code, value)
                else:
                    behind = next((i for i in level(code, value, stop) if code[i] == ","), stop)
                patterns.append((first, arrow))
                arms.append((first, behind, said(first, arrow), calls(code, (value, behind)), True))
                at = behind
        else:
            heads = [i for i in level(code, inner, stop) if re.match(r"(?:case|default)\b", code[i:stop]) and not re.match(r"[\w.]", code[i - 1])]
            for head, behind in zip(heads, [*heads[1:], stop]):
                colon = next((i for i in level(code, head, behind) if code[i] == ":" and code[i + 1] != "="), behind)
                what = said(head, colon)
                listed = m[0] == "switch" or what == "default"  # communication cases are no points
                arms.append((head, behind, what if what == "default" else what[4:].strip(), calls(code, (colon, behind)), listed))
        out += [(a, b, "arm", cond, len(arms), called, False) for a, b, cond, called, listed in arms if listed]
    for m in re.compile(r"\bif\b").finditer(code, start, end):
        if any(a <= m.start() < b for a, b in patterns):
            continue
        brace = block_of(code, m.end(), end)
        if brace < 0:
            continue
        stop = closing(code, brace)
        cut = max((i + 1 for i in level(code, m.end(), brace) if code[i] == ";"), default=m.end())
        condition, other, behind = said(cut, brace), [], stop
        while more := re.match(r"\s*else\b", code[behind:end]):
            nested = block_of(code, behind + more.end() + (len(n[0]) if (n := re.match(r"\s*if\b", code[behind + more.end() : end])) else 0), end)
            if nested < 0:
                break
            behind = closing(code, nested)
        if behind > stop:
            other = [(stop, behind)]
        last = last_statement(code, brace + 1, stop - 1, ext)
        compact, inner = re.sub(r"\s", "", condition), re.sub(r"\s", "", code[brace + 1 : stop - 1]).rstrip(";")
        routine = inner == "returnerr" if compact == "err!=nil" else ext == "go" and "==nil" in compact and inner in ("return", "continue")
        out.append((m.start(), behind, "guard" if re.match(r"return\b", last) else "branch", condition, 1 + bool(other), calls(code, (brace, stop), *other), routine))
    for m in re.compile(r"\breturn\b[ \t]*" if ext == "go" else r"\breturn\b\s*").finditer(code, start, end):
        stop = next((i for i in level(code, m.end(), end) if code[i] in ";})]," or (ext == "go" and code[i] == "\n")), end)
        if LITERAL.fullmatch(value := said(m.end(), stop)):
            out.append((m.start(), stop, "literal_return", value, 1, [], False))
    for m in re.compile(r"(?<=[\w)\]}?>])\s*\?(?!\w)").finditer(code, start, end) if ext == "rs" else ():
        at = operand(code, m.start())
        out.append((at, m.end(), "error", said(at, m.end() - 1), 1, calls(code, (at, m.end())), True))
    return out


def rust_constants(text: str, code: str, start: int, end: int) -> Iterator[tuple[str, tuple]]:
    for m in re.compile(r"\bconst\s+([A-Za-z_]\w*)\s*:(?!:)").finditer(code, start, end):
        if re.search(r"[<,]\s*\Z", code[max(0, m.start() - 200) : m.start()]):
            continue
        stop = next((i for i in level(code, m.end(), end) if code[i] == ";"), end)
        angle, equal = 0, -1
        for i in level(code, m.end(), stop):
            angle += (code[i] == "<") - (code[i] == ">" and code[i - 1] != "-")
            if code[i] == "=" and angle <= 0:
                equal = i
                break
        yield m[1], (m.start(), stop, "constant", text[equal + 1 : stop].strip() if equal >= 0 else m[1], 1, [], False)


def go_constants(text: str, code: str, start: int, end: int) -> Iterator[tuple[str, tuple]]:
    for m in re.compile(r"\bconst\b[ \t]*").finditer(code, start, end):
        group = code.startswith("(", m.end())
        at = m.end() + group
        stop = closing(code, m.end()) - 1 if group else next((i for i in level(code, at, end) if code[i] in ";\n"), end)
        cuts = [i for i in level(code, at, stop) if code[i] == ";" or (code[i] == "\n" and code[at:i].rstrip()[-1:] not in tuple("+-*/%&|^<>=!,."))]
        for a, b in zip([at, *(i + 1 for i in cuts)], [*cuts, stop]):
            names = re.match(r"\s*(\w+(?:\s*,\s*\w+)*)", code[a:b])
            if not names:
                continue
            equal = code.find("=", a, b)
            value = text[equal + 1 : b].strip() if equal >= 0 else ""
            for name in re.split(r"\s*,\s*", names[1]):
                yield name, (a + names.start(1), b, "constant", value or re.match(r"\w+", names[1])[0], 1, [], False)


def source_decisions(path: str, text: str, ext: str) -> list[dict]:
    """Decision points of the functions and constants of one Rust or Go file, in order."""
    bare = code = masked(text, ext)
    plain = HIDDEN[ext].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][:2] in ("//", "/*") else m[0], text)
    if ext == "rs":
        for m in MACRO.finditer(bare):
            code = blank(code, m.end() - 1, closing(bare, m.end() - 1))
        items = [(m.start(), end, m.end(), m[1], f"{prefix}::{m[3] or m[2]}") for m, prefix, _, end in rust_items(path, bare)]
        functions = [(a, b, body, name) for a, b, body, word, name in items if word == "fn"]
        module = re.sub(r"^src/|\.rs$|/mod$", "", re.sub(r"\.rs$", "", path)).replace("/", "::")
        holds = [(a, b, name) for a, b, _, _, name in items]
        join, constants = "::".join, rust_constants
    else:
        package = path.rsplit("/", 1)[0].removeprefix("src/").replace("/", ".") if "/" in path else ""
        join = lambda parts: ".".join(p for p in parts if p)
        functions = [(m.start(), body_end(bare, m.end()), m.end(), join([package, m[1], m[2]])) for m in GO_FUNC.finditer(bare)]
        module, holds, constants = package, [], go_constants
    marked: list[tuple[str, tuple]] = []
    outside = code
    for a, b, body, canonical in functions:
        outside = blank(outside, a, b)
        own = code[:b]
        for x, y, *_ in functions:
            if a < x and y <= b:
                own = blank(own, x, y)
        opened = own.find("{", body, b)
        own = without_closures(own, opened, b, ext) if opened >= 0 else own
        found = points(text, plain, own, opened, b, ext) if opened >= 0 else []
        found += [p for _, p in constants(text, own, max(opened, body), b)]
        marked += [(canonical, p) for p in found]
    for name, p in constants(text, outside, 0, len(outside)):
        around = max((h for h in holds if h[0] < p[0] < h[1]), default=(0, 0, module))[2]
        marked.append((join([around, name]), p))
    out, seen = [], {}
    for canonical, (a, _, kind, condition, branches, called, routine) in sorted(marked, key=lambda r: (r[1][0], r[1][1], r[0])):
        mark = digest(f"{kind}:{re.sub(r'\s', '', condition)}")[:16]
        seen[canonical, mark] = seen.get((canonical, mark), 0) + 1
        out.append({"canonical": canonical, "kind": kind, "line": text.count("\n", 0, a) + 1, "condition": condition, "fingerprint": mark, "ordinal": seen[canonical, mark], "branches": branches, "controlled": called, "routine": routine})
    return out


def without_closures(code: str, start: int, end: int, ext: str) -> str:
    """The code with the closures of a body blanked out."""
    at = start
    while m := (CLOSURE if ext == "rs" else FUNC_LITERAL).search(code, at, end):
        at = m.end()
        if ext == "rs":
            head = re.compile(r"\s*(?:->[^{;]*)?").match(code, m.end()).end()
            stop = closing(code, head) if code.startswith("{", head) else next((i for i in level(code, head, end) if code[i] in ",;)]}"), end)
            code = blank(code, m.start(1), stop)
        else:
            brace = re.compile(r"(?:[^\n{};=]|\b(?:interface|struct)\s*\{\s*\})*").match(code, closing(code, m.end() - 1)).end()
            if code.startswith("{", brace):
                code = blank(code, m.start(), closing(code, brace))
    return code
