"""Markup residue in text documents.

A text is cut into blocks. The first pass decides from stop-word density, length and link density
whether a block is text or residue, and from its own constructs which language it is in. The second
pass lets the undecided ones, short blocks and constructs that two languages share, inherit from
the nearest decided neighbour. Both the languages found and the clean text are read off the blocks
so classified. Headings, lists, code blocks and formulas survive the cleaning.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

ADF, HTML, MARKDOWN, WIKI, LATEX = "adf", "html", "markdown", "wiki", "latex"
# Names of HTML elements.
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta "
    "nav ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot "
    "th thead title tr tt u ul var video"
).split()
# LaTeX commands that take no argument in running text.
BARE_COMMANDS = (
    "item alpha beta gamma delta epsilon lambda mu pi sigma theta omega sum prod int frac sqrt leq geq neq approx times cdot infty "
    "to rightarrow ldots dots log exp par noindent newline newpage maketitle tableofcontents centering hline bigskip medskip smallskip LaTeX TeX"
).split()
# Frequent function words of the corpus languages.
STOP = set(
    "the a an and or but of to in on for with at by from is are was be this that it as not no when so we you i if then than "
    "der die das und oder aber ein eine einen mit von zu im am auf für ist sind nicht den dem des sich bei nach seit "
    "le la les un une des et ou mais de du au aux en dans sur pour avec est sont ne pas que qui "
    "el los las una y o pero del al en para con es son no se su por que lo".split()
)
MATH = re.compile(r"[\\^_={}+<>]|\w\(|^\s*[A-Za-z]\s*$")

TAG = re.compile(rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
ENTITY = re.compile(r"&(?:#\d{1,6}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z]{2,8}));")
CODE = re.compile(
    r"(?P<fence>^[ \t]*(?P<tick>`{3,}|~{3,})[^\n]*\n(?P<fenced>.*?)(?:^[ \t]*(?P=tick)[ \t]*\r?$|\Z))"
    r"|(?P<macro>(?<![/\w])\{(?P<name>code|noformat)(?::[^{}\n]*)?\}(?P<inmacro>.*?)\{(?P=name)\})"
    r"|(?P<pre><(?P<el>pre|script|style)\b[^>]*>(?P<inpre>.*?)(?:</(?P=el)\s*>|\Z))"
    r"|(?P<verb>\\begin\{(?P<env>verbatim|lstlisting|minted|alltt)\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*(?P<inverb>.*?)(?:\\end\{(?P=env)\*?\}|\Z))"
    r"|(?P<tag><(?P<el2>code|tt|kbd|samp)\b[^>]*>(?P<intag>.*?)</(?P=el2)\s*>)"
    r"|(?P<mono>\{\{(?P<inmono>[^{}\n]+)\}\})"
    r"|(?P<ticks>(?P<t2>`{1,2})(?!`)(?P<inticks>[^`\n]+)(?P=t2)(?!`))"
    r"|(?P<tt>\\(?:texttt|verb|lstinline)(?:\{(?P<intt>(?:[^{}\\]|\\.)*)\}|\|[^|\n]*\|))",
    re.S | re.M | re.I,
)
CODE_OF = {"fence": MARKDOWN, "ticks": MARKDOWN, "macro": WIKI, "mono": WIKI, "pre": HTML, "tag": HTML, "verb": LATEX, "tt": LATEX}
BLOCK_CODE = {"fence": "fenced", "macro": "inmacro", "pre": "inpre", "verb": "inverb"}
INLINE_CODE = {"tag": "intag", "mono": "inmono", "ticks": "inticks", "tt": "intt"}
FORMULA = re.compile(
    r"\$\$(?P<d>[^$]+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<p>.+?)\\\)|(?<![\\$\w])\$(?![\s\d.,]*\s)(?P<i>[^$\n]+?)(?<![\s\\])\$(?![\w$])", re.S
)
COMMAND = re.compile(
    r"(?<!\\)\\(?:(?:begin|end)\{\w+\*?\}|(?:documentclass|usepackage|(?:sub){0,2}section|(?:sub)?paragraph|chapter|title|author|text[a-z]{2,}|emph|underline|href|url|footnote|cite[a-z]*|ref|label|caption|includegraphics|input|newcommand)\*?\s*[\[{]"
    rf"|(?:{'|'.join(BARE_COMMANDS)})(?![A-Za-z]))"
)
MD_LINE = re.compile(r"^[ \t]{0,3}(?:#{2,6}[ \t]+\S|>[ \t]?\S|\+[ \t]+\S|[-*+][ \t]+\[[ xX]\][ \t]|(?:\*[ \t]*){3,}$|-{3}[ \t]*$|={3,}[ \t]*$)", re.M)
MD_HEAD = re.compile(r"^#[ \t]+\S[^\n]*$", re.M)
MD_NUMBER = re.compile(r"^[ \t]*(\d{1,3})[.)][ \t]+\S", re.M)
MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:<[^<>\n]*>|[^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)|<https?://[^<>\s]+>")
MD_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^_\n]* [^_\n]*(?<=[^\s_])__(?![\w_])|(?<![\w~])~~(?=[^\s~])[^~\n]*~~(?![\w~])")
WIKI_LINE = re.compile(r"^[ \t]*(?:h[1-6]\.[ \t]+\S|bq\.[ \t]+\S|\|\|[^|\n]+\|\||(?:\*{2,}|#{2,}|#\*|\*#|\*-)[ \t]+\S[^\n]*\n[ \t]*[*#]+[ \t])", re.M)
WIKI_LIST = re.compile(r"^#[ \t]+\S[^\n]*\n#[#*]*[ \t]+\S", re.M)
WIKI_ROW = re.compile(r"^[ \t]*\|[^|\n]+\|(?:[^|\n]*\|)*[ \t]*$", re.M)
WIKI_INLINE = re.compile(
    r"\[[^\[\]|\n]+\|[^\[\]\s|]+(?:\|[^\[\]\n]*)?\]|\[(?:https?://|mailto:|~|\^)[^\[\]\s]+\]|(?<![\w!])!(?=\S)[^\s!|]+\.(?:png|jpe?g|gif|svg|bmp|pdf)(?:\|[^!\n]*)?!"
    r"|(?<![/\w])\{(quote|panel|color|info|note|tip|warning|expand|toc|anchor)(?::[^{}\n]*)?\}|(?<![\w?])\?\?(?=\S)[^?\n]*\?\?(?!\?)"
)
SHARED_LIST = re.compile(r"^[ \t]*[*-][ \t]+\S", re.M)
SHARED_WORD = re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/.$])_(?=[^\s_])[^_\n]*(?<=[^\s_])_(?![\w_])")
URL = re.compile(r"https?://[^\s<>\"|\])}]+")
PARAGRAPH = re.compile(r"\n[ \t]*\n")
CODE_MARK = re.compile("\x02(\\d+)\x03")
OBJECT = re.compile(r"\s*\{\s*\"")
ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.S | re.I)


def is_formula(m: re.Match) -> bool:
    """A double dollar or bracket form with mathematics in it; a single dollar only with strong signs.

    Amounts of money, shell variables and words between two dollars are none.
    """
    if m["i"] is not None:
        return bool(re.search(r"[\\^={}]|\w_|[A-Za-z]\([^)]*\)$", m["i"]) or re.fullmatch(r"[A-Za-z]|[A-Za-z]\s?[+<>-]\s?\w+", m["i"]))
    return bool(MATH.search(next(g for g in m.groups() if g is not None)))


@dataclass
class Block:
    kind: str
    text: str
    level: int = 0
    dialect: str | None = None
    keep: bool | None = None
    raw: str | None = None


# --- the tracker's JSON tree ------------------------------------------------------------------

JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:(?P<end>")|\\?\Z)|[{}\[\],:]|[^\s{}\[\],:"]+', re.S)
HALF_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)\\(?:u[0-9a-fA-F]{0,3})?$")
# Node types of the tree that begin a block, and what they become.
TREE_BLOCKS = {"paragraph": "text", "heading": "heading", "codeBlock": "code", "listItem": "item", "taskItem": "item", "decisionItem": "item", "tableCell": "text", "tableHeader": "text", "blockquote": "text", "rule": "text", "panel": "text"}


def mended(text: str) -> str:
    """A JSON text that was cut off, ended after its last whole value, with what stands open closed."""
    open_: list[list[str]] = []  # closing bracket, what comes next
    upto, tail = 0, ""

    def whole(end: int) -> None:
        nonlocal upto, tail
        upto, tail = end, "".join(b for b, _ in reversed(open_))

    for m in JSON_TOKEN.finditer(text):
        t = m[0]
        if t in "{[":
            open_.append(["}", "key"] if t == "{" else ["]", "value"])
            whole(m.end())
        elif t in "}]":
            if open_:
                open_.pop()
            whole(m.end())
        elif t in ",:":
            if open_:
                open_[-1][1] = "value" if t == ":" or open_[-1][0] == "]" else "key"
        elif open_ and open_[-1][1] == "value":
            if t[0] == '"' and not m["end"]:
                return text[: m.start()] + HALF_ESCAPE.sub(r"\1", t) + '"' + "".join(b for b, _ in reversed(open_))
            if t[0] == '"' or m.end() < len(text):
                whole(m.end())
    return text[:upto] + tail


def tree_of(text: str) -> dict | None:
    """The tracker's tree that a text is, wherever its type stands; null for anything else.

    A tree that is cut off is read as far as it goes; one cut before its type is known by its content.
    """
    if not OBJECT.match(text):
        return None
    try:
        tree, cut = json.loads(text), False
    except RecursionError:
        return None
    except ValueError:
        try:
            tree, cut = json.loads(mended(text)), True
        except (ValueError, RecursionError):
            return None
    if not isinstance(tree, dict):
        return None
    if tree.get("type") == "doc":
        return tree
    return tree if cut and "type" not in tree and isinstance(tree.get("content"), list) else None


def tree_blocks(tree: dict) -> list[tuple[Block, list[tuple[str, bool]]]]:
    """Blocks of a tree in order, each with its pieces of text and whether they are code."""
    out: list[tuple[Block, list[tuple[str, bool]]]] = []
    stack: list = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
            continue
        if not isinstance(node, dict):
            continue
        kind = node.get("type")
        if kind == "text" or (kind not in TREE_BLOCKS and isinstance(node.get("text"), str)):
            marks = node.get("marks") if isinstance(node.get("marks"), list) else []
            code = any(isinstance(k, dict) and k.get("type") == "code" for k in marks)
            if not out:
                out.append((Block("text", "", 0, ADF), []))
            out[-1][1].append((str(node.get("text") or ""), code or out[-1][0].kind == "code"))
        elif kind == "hardBreak" and out:
            out[-1][1].append(("\n", False))
        elif kind in TREE_BLOCKS and not (kind == "paragraph" and out and out[-1][0].kind == "item" and not out[-1][1]):
            attrs = node.get("attrs") if isinstance(node.get("attrs"), dict) else {}
            level = attrs.get("level") if kind == "heading" else 0
            out.append((Block(TREE_BLOCKS[kind], "", level if isinstance(level, int) else 2, ADF), []))
        stack.append(node.get("content") or [])
    return out


# --- languages of a text ----------------------------------------------------------------------


def distinct_signs(text: str) -> set[str]:
    """Languages of which the text (code taken out) holds a construct no other language shares."""
    found: set[str] = set()
    if "<" in text and (TAG.search(text) or COMMENT.search(text)):
        found.add(HTML)
    if "&" in text and any(m[1] is None or m[1] + ";" in html.entities.html5 for m in ENTITY.finditer(text)):
        found.add(HTML)
    if ("$" in text or "\\" in text) and (COMMAND.search(text) or any(map(is_formula, FORMULA.finditer(text)))):
        found.add(LATEX)
    bare = strip_foreign(text)
    if MD_LINE.search(bare) or MD_TABLE.search(bare):
        found.add(MARKDOWN)
    if "](" in bare or "<http" in bare:
        if MD_LINK.search(bare):
            found.add(MARKDOWN)
    if ("**" in bare or "__" in bare or "~~" in bare) and MD_STRONG.search(bare):
        found.add(MARKDOWN)
    if "#" in bare and WIKI_LIST.search(bare):
        found.add(WIKI)
    numbers = [int(n) for n in MD_NUMBER.findall(bare)]
    if numbers and (numbers[0] == 1 or any(b == a + 1 for a, b in zip(numbers, numbers[1:]))):
        found.add(MARKDOWN)
    if WIKI_LINE.search(bare) or (("[" in bare or "!" in bare or "{" in bare or "??" in bare) and WIKI_INLINE.search(bare)):
        found.add(WIKI)
    if "|" in bare and WIKI not in found and WIKI_ROW.search(bare) and not MD_TABLE.search(bare):
        found.add(WIKI)
    return found


def strip_foreign(text: str) -> str:
    """The text without tags, comments, formulas and escapes, whose signs are no Markdown or wiki."""
    if "<" in text:
        text = TAG.sub(" ", COMMENT.sub(" ", text))
    if "$" in text or "\\" in text:
        text = FORMULA.sub(lambda m: " " if is_formula(m) else m[0], text)
        text = re.sub(r"\\[_*#&%{}$]", " ", text)
    return text


def shared_signs(text: str) -> bool:
    """Whether the text holds what Markdown and wiki write alike: emphasis, a list, one ``#`` line."""
    bare = strip_foreign(text)
    if "#" in bare and MD_HEAD.search(bare):
        return True
    if ("*" in bare or "-" in bare) and SHARED_LIST.search(bare):
        return True
    return ("*" in bare or "_" in bare) and bool(SHARED_WORD.search(URL.sub(" ", bare)))


def split_code(text: str) -> tuple[str, set[str], list[tuple[str, str, str]]]:
    """The text with code replaced by marks, the languages of the code marks, and (shape, code, language)."""
    if not ("`" in text or "~~~" in text or "{" in text or "<" in text or "\\" in text):
        return text, set(), []
    found: set[str] = set()
    kept: list[tuple[str, str, str]] = []

    def put(m: re.Match) -> str:
        kind = next(k for k in CODE_OF if m[k] is not None)
        found.add(CODE_OF[kind])
        code = m[BLOCK_CODE.get(kind) or INLINE_CODE[kind]] or ("" if kind in BLOCK_CODE else m[0])
        if CODE_OF[kind] == HTML:
            code = html.unescape(re.sub(r"</?code\b[^>]*>", "", code, flags=re.I))
        if kind in BLOCK_CODE:
            kept.append(("block", code, CODE_OF[kind]))
            return f"\n\n\x02{len(kept) - 1}\x03\n\n"
        kept.append(("inline", code, CODE_OF[kind]))
        return f"\x02{len(kept) - 1}\x03"

    return CODE.sub(put, text), found, kept


def languages(text: str | None) -> set[str]:
    """Markup languages of which the text holds at least one construct.

    A null or empty text has none. Inside the tracker's tree only formulas count besides. What
    stands in code does not count. The blocks are classified in two passes; what Markdown and wiki
    share counts in blocks that are text, not in residue, and there inherits the language of the
    nearest block that is decided; where there is none it is Markdown.
    """
    if not text:
        return set()
    tree = tree_of(text)
    if tree is not None:
        plain = ("".join(" " if code else t for t, code in pieces) for _, pieces in tree_blocks(tree))
        return {ADF, LATEX} if any(("$" in t or "\\" in t) and any(map(is_formula, FORMULA.finditer(t))) for t in plain) else {ADF}
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    bare, found, codes = split_code(text)
    blocks = [Block(shape_of(p), p) for p in PARAGRAPH.split(bare) if p.strip()]
    shared = []
    for b in blocks:
        signs = distinct_signs(b.text)
        found |= signs
        signs |= {codes[int(k)][2] for k in CODE_MARK.findall(b.text)}
        b.dialect = MARKDOWN if MARKDOWN in signs else WIKI if WIKI in signs else None
        if b.dialect is None and shared_signs(b.text):
            shared.append(b)
    if shared:
        for b in blocks:
            b.keep = first_pass(b)
        second_pass(blocks)
        inherit(blocks, "dialect", MARKDOWN)
        found |= {b.dialect for b in shared if b.keep}
    return found


def shape_of(part: str) -> str:
    """What a block of marked-up text is by its first sign."""
    return "item" if SHARED_LIST.match(part.lstrip("\n")) else "heading" if MD_HEAD.match(part.lstrip("\n")) else "text"


# --- cleaning ---------------------------------------------------------------------------------

LINK_LABELS = re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)|\[([^\[\]\n]*)\]\([^()\n]*\)|\[([^\[\]|\n]+)\|[^\[\]\n]+\]|\\href\{[^{}\n]*\}\{([^{}\n]*)\}")
DROP = re.compile(
    r"(?<![\w!])![^\s!|]+\.\w{2,4}(?:\|[^!\n]*)?!|\{(?:quote|panel|color|info|note|tip|warning|expand|toc|anchor)(?::[^{}\n]*)?\}"
    r"|\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*|\\(?:noindent|par|centering|hline|maketitle|newpage)(?![A-Za-z])"
)
EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*?)(?<=[^\s*])\1(?![\w*])|(?<![\w_])(_{1,2})(?=[^\s_])([^_\n]* [^_\n]*|[^_\n]+?)(?<=[^\s_])\3(?![\w_])|(?<![\w~])~~([^~\n]+)~~")
WRAPPED = re.compile(r"\\(?:textbf|textit|emph|underline|textsc|textrm|text|title|author|caption)\{([^{}]*)\}")
LATEX_HEAD = re.compile(r"\\((?:sub){0,2})section\*?\{([^{}]*)\}")
BREAKS = re.compile(r"</?(?:p|div|ul|ol|table|thead|tbody|tr|blockquote|section|article|h[1-6]|br|hr|li|td|th|pre|body|html|head)\b[^>]*>", re.I)


def inline(text: str) -> str:
    """Running text without inline markup: labels of links, words of emphasis, characters of entities."""
    text = TAG.sub("", COMMENT.sub("", text))
    text = LINK_LABELS.sub(lambda m: next((g for g in m.groups() if g is not None), ""), text)
    text = WRAPPED.sub(r"\1", DROP.sub("", text))
    text = EMPHASIS.sub(lambda m: m[2] or m[4] or m[5] or "", text)
    text = html.unescape(text) if "&" in text else text
    return re.sub(r"[ \t]+", " ", re.sub(r"\\([_#&%{}$])", r"\1", text)).strip()


def html_lines(text: str) -> str:
    """HTML block elements as lines with the signs of headings and list items."""

    def line(m: re.Match) -> str:
        tag = re.match(r"</?\s*(\w+)", m[0])[1].lower()
        closing = m[0][1] == "/"
        if tag[0] == "h" and tag[1:].isdigit():
            return "\n\n" if closing else "\n\n" + "#" * int(tag[1:]) + "  "
        if tag == "li":
            return "" if closing else "\n- "
        return " | " if tag in ("td", "th") and closing else "\n" if tag in ("br", "tr", "li", "td", "th") else "\n\n"

    return BREAKS.sub(line, text)


def blocks_of(text: str) -> list[Block]:
    """Blocks of a text: heading, item, code, formula or text, in order."""
    tree = tree_of(text)
    if tree is not None:
        for b, pieces in (own := tree_blocks(tree)):
            b.text = "".join(t for t, _ in pieces)
        return [b for b, _ in own if b.text.strip()]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    bare, _, codes = split_code(text)
    wiki_lists = bool(WIKI_LIST.search(bare))
    if "<" in bare:
        bare = html_lines(COMMENT.sub("", bare))
    bare = LATEX_HEAD.sub(lambda m: "\n\n" + "#" * (len(m[1]) // 3 + 1) + "  " + m[2] + "\n\n", bare)
    out = []
    for para in PARAGRAPH.split(bare):
        running: list[str] = []

        def flush() -> None:
            if running:
                out.append(Block("text", " ".join(running)))
                running.clear()

        for raw in para.split("\n"):
            line = raw.strip()
            whole = re.fullmatch(r"\x02(\d+)\x03", line)
            if not line or MD_TABLE.fullmatch(line):
                continue
            if whole and codes[int(whole[1])][0] == "block":
                flush()
                out.append(Block("code", codes[int(whole[1])][1].strip("\n")))
            elif m := re.match(r"(#{1,6})  ?(?=\S)|h([1-6])\. +", line) if not (wiki_lists and line.startswith("# ")) else None:
                flush()
                out.append(Block("heading", line[m.end() :].strip(" #"), len(m[1]) if m[1] else int(m[2])))
            elif m := re.match(r"(?:[-*+•]+|#+|\d{1,3}[.)]|\\item)[ \t]+(?=\S)", line):
                flush()
                out.append(Block("item", line[m.end() :]))
            elif (f := FORMULA.fullmatch(line)) and is_formula(f):
                flush()
                out.append(Block("formula", line))
            else:
                running.append(line.lstrip("> ") if line.startswith(">") else line)
        flush()
    for b in out:
        if b.kind not in ("code", "formula"):
            b.raw = b.text
            parts = re.split(r"(\$[^$\n]+\$|\\\(.+?\\\))", b.text)
            b.text = "".join(p if i % 2 else (" " if p[:1] == " " else "") + inline(p) + (" " if p[-1:] == " " and p.strip() else "") for i, p in enumerate(parts))
            b.text = re.sub(r"\x02(\d+)\x03", lambda m: codes[int(m[1])][1], b.text).strip()
    return [b for b in out if b.text.strip()]


SHORT, LONG = 8, 20


def link_density(b: Block) -> tuple[float, int]:
    """Share of a block's visible text that labels of links and bare addresses make up; number of links."""
    raw = b.text if b.raw is None else b.raw
    if "http" not in raw and "](" not in raw and "|" not in raw and "<a" not in raw and "\\href" not in raw:
        return 0.0, 0
    labels = [next((g for g in m.groups() if g), "") for m in LINK_LABELS.finditer(raw)]
    bare = LINK_LABELS.sub(" ", raw)
    labels += [TAG.sub("", m[1]) for m in ANCHOR.finditer(bare)]
    bare = ANCHOR.sub(" ", bare)
    urls = URL.findall(bare)
    linked, rest = sum(map(len, labels)) + sum(map(len, urls)), len(re.sub(r"\s+", "", URL.sub("", bare)))
    return linked / max(1, linked + rest), len(labels) + len(urls)


def first_pass(b: Block) -> bool | None:
    """Text (True), residue (False) or undecided, from structure, stop-word density, length and link
    density. Structure that has to survive is always text."""
    if b.kind in ("code", "formula", "heading", "item"):
        return True
    words = b.text.split()
    linked, links = link_density(b)
    stops = sum(w.strip(".,;:!?").lower() in STOP for w in words) / max(1, len(words))
    if linked > 0.6:
        return False if links > 1 or b.text.lstrip().startswith("http") else None
    if len(words) < SHORT:
        return True if stops >= 0.3 and b.text[-1:] in ".!?" else None
    if stops >= 0.08 or len(words) >= LONG:
        return True
    return None


def inherit(blocks: list[Block], field: str, default) -> None:
    """Undecided blocks take the label of the nearest decided one, the earlier on a tie."""
    labels = [getattr(b, field) for b in blocks]
    decided = [i for i, x in enumerate(labels) if x is not None]
    k = 0
    for i, b in enumerate(blocks):
        while k + 1 < len(decided) and abs(decided[k + 1] - i) < abs(decided[k] - i):
            k += 1
        if labels[i] is None:
            setattr(b, field, labels[decided[k]] if decided else default)


def second_pass(blocks: list[Block]) -> None:
    """Whether undecided blocks stay follows from their nearest decided neighbour; alone they do."""
    inherit(blocks, "keep", True)


def clean(text: str | None) -> str | None:
    """Clean text: ``#`` headings, ``-`` items, fenced code and formulas; null stays null."""
    if not text:
        return text
    blocks = blocks_of(text)
    for b in blocks:
        b.keep = first_pass(b)
    second_pass(blocks)
    out, last = [], ""
    for b in blocks:
        if not b.keep:
            continue
        shown = {"heading": "#" * max(1, b.level) + " " + b.text, "item": "- " + b.text, "code": f"```\n{b.text}\n```"}.get(b.kind, b.text)
        out.append(("\n" if b.kind == last == "item" else "\n\n" if out else "") + shown)
        last = b.kind
    return "".join(out)


# --- over tables ------------------------------------------------------------------------------


def markup_found(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, markup), one row per language that a text holds, from rows
    (src_table, row_id, text). Repeated rows count once; only the few small results are shuffled.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for name in sorted(languages(text)):
                    at.append(k)
                    names.append(name)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(names, pa.string())], names=["src_table", "row_id", "markup"]
            )

    source = rows.select("src_table", "row_id", "text").filter(F.col("text") != "")
    return source.mapInArrow(run, "src_table string, row_id bigint, markup string").distinct()


def cleaned(rows: DataFrame) -> DataFrame:
    """(src_table, row_id, text) with every text cleaned; rows come out as often as they are."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["src_table", "row_id", "text"])

    return rows.select("src_table", "row_id", "text").mapInArrow(run, "src_table string, row_id bigint, text string")
