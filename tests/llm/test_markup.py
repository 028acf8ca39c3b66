import json

import pytest

from lodestone.llm import markup as m

TREE = {"version": 1, "type": "doc", "content": [
    {"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "Head"}]},
    {"type": "paragraph", "content": [{"type": "text", "text": "So it is the case. "}, {"type": "text", "text": "x_1", "marks": [{"type": "code"}]}]},
    {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "one item of the list"}]}]}]},
    {"type": "codeBlock", "content": [{"type": "text", "text": "a = $x^2$"}]},
]}
WITH = json.loads(json.dumps(TREE))
WITH["content"].append({"type": "paragraph", "content": [{"type": "text", "text": "$$\\frac{a}{b}$$"}]})

CASES = [
    (None, set()), ("", set()), ("Plain words, nothing more.", set()),
    ("It fails when a < 2 && b > 7. Vec<String> and Option<u32>.", set()), ("Plan A costs $7 and plan B $22 per seat.", set()), ("Set $HOME and __init__ path, snake_case_entry stays.", set()),
    ("So 2 * 3 * 4 rows, i.e. h2. [WIP] passes *args through. #787 and !20. GET /v1/x/{id} -> 204.", set()),
    ("**bold** text", {"markdown"}), ("# Title\n\ntext", {"markdown"}), ("[a](https://x.y) and `code`", {"markdown"}), ("1. one\n2. two", {"markdown"}), ("```\n<b>x</b> h2. {{a}}\n```", {"markdown"}), ("+ one\n+ two", {"markdown"}),
    ("> quoted", {"markdown"}), ("| a | b |\n|---|---|\n| 1 | 2 |", {"markdown"}),
    ("h3. Title", {"wiki"}), ("{{mono}} text", {"wiki"}), ("{code:sql}\nSELECT `x` **y**\n{code}", {"wiki"}), ("[a|https://x.y]", {"wiki"}), ("||h||\n|a|", {"wiki"}), ("# one\n# two", {"wiki"}), ("!a.png|thumbnail!", {"wiki"}), ("bq. said", {"wiki"}),
    ("_word_ here", {"markdown"}), ("* one\n* two", {"markdown"}), ("* one\n* two\n\nh2. Head", {"wiki"}), ("*strong* and {{x}}", {"wiki"}), ("_em_ and **strong**", {"markdown"}),
    ("<p>text</p>", {"html"}), ("a&nbsp;b", {"html"}), ("x <!-- note --> y", {"html"}), ("<pre><code>**x** &lt;</code></pre>", {"html"}),
    ("\\textbf{x} text", {"latex"}), ("here $\\alpha + \\beta_{2}$ is", {"latex"}), ("\\[O(n \\log n)\\]", {"latex"}), ("$$a^2$$", {"latex"}), ("\\begin{verbatim}<b>**x**</b>\\end{verbatim}", {"latex"}), ("\\[WIP\\] text", set()),
    ("# one\n\nh2. Head", {"wiki"}), ("h2. Head\n\n_a_\n\ntext\n\n**b**", {"wiki", "markdown"}), ("**b** <b>x</b> \\emph{y}", {"markdown", "html", "latex"}), ("h2. A\r\n\r\n# one\r\n# two", {"wiki"}),
    (json.dumps(TREE), {"adf"}), (json.dumps(WITH), {"adf", "latex"}), (json.dumps(WITH)[:-5], {"adf", "latex"}), (json.dumps(TREE)[:120], {"adf"}),
]


LATE = json.dumps({"content": TREE["content"], "version": 1, "type": "doc"})
FORMULA = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"marks": [{"type": "code"}], "type": "text", "text": "a"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "$$O(n \\log n)$$"}]}]})


@pytest.mark.parametrize(
    "text,want",
    [
        (LATE, {"adf"}), (FORMULA, {"adf", "latex"}), (FORMULA.replace("doc", "page"), {"latex"}), (json.dumps({"type": "doc", "content": [{"type": "codeBlock", "content": [{"type": "text", "text": "$x^2$"}]}]}), {"adf"}),
        (json.dumps({"pad": "x" * 500, "type": "doc", "content": []}), {"adf"}), ('{"a": 1}', set()), ('{"type": "doc", "content": ' + "[" * 100_000, set()),
    ],
)
def test_trees_of_any_order(text, want):
    assert m.languages(text) == want


def test_a_tree_cut_anywhere_is_read_as_far_as_it_goes():
    whole = json.dumps(WITH)
    for n in range(len(whole) - 1, whole.index('"doc"') + 5, -1):
        assert m.ADF in m.languages(whole[:n]), whole[:n]
    shown = whole.index("{a}{b}$$") + len("{a}{b}$$")
    assert all(m.LATEX in m.languages(whole[:n]) for n in range(shown, len(whole)))


def test_link_density_and_items():
    dense = m.Block("text", "Home Docs Help", raw="[Home](https://a.example/x) [Docs](https://b.example) [Help|https://c.example]")
    one = m.Block("text", "the page", raw="[the page](https://a.example/x)")
    assert m.first_pass(dense) is False and m.first_pass(one) is None
    assert m.clean("https://a.example/x https://b.example/y\n\n- x\n- https://c.example") == "- x\n- https://c.example"
    assert m.languages("https://a.example/*a* https://b.example/*b* *c*\n\nplain text of the page and of the rest.") == set()


@pytest.mark.parametrize("text,want", CASES)
def test_languages(text, want):
    assert m.languages(text) == want


def test_clean_keeps_structure():
    assert m.clean(json.dumps(WITH)) == "## Head\n\nSo it is the case. x_1\n\n- one item of the list\n\n```\na = $x^2$\n```\n\n$$\\frac{a}{b}$$"
    md = "# Title\n\nThis is **bold** and [a link](https://x.y) to the page.\n\n- one of the items\n- two of the items\n\n```py\nx = 1\n```\n\nand $a_{1}$ holds for the rest of it."
    assert m.clean(md) == "# Title\n\nThis is bold and a link to the page.\n\n- one of the items\n- two of the items\n\n```\nx = 1\n```\n\nand $a_{1}$ holds for the rest of it."
    page = "<h2>Title</h2><p>This is <b>the</b> text &amp; more of it.</p><ul><li>one of the items</li></ul><pre><code>a &lt; b</code></pre>"
    assert m.clean(page) == "## Title\n\nThis is the text & more of it.\n\n- one of the items\n\n```\na < b\n```"
    assert m.clean("h2. Title\n\n{code}\nx\n{code}\n\nSee [the page|https://x.y] for the rest of it.") == "## Title\n\n```\nx\n```\n\nSee the page for the rest of it."
    assert m.clean(None) is None and m.clean("") == ""


def test_short_blocks_inherit():
    blocks = [m.Block("text", "https://a.example/x https://b.example/y", 0), m.Block("text", "Next page", 0), m.Block("text", "This is a long line of the text with many of the words in it.", 0), m.Block("text", "Thanks", 0)]
    for b in blocks:
        b.keep = m.first_pass(b)
    assert [b.keep for b in blocks] == [False, None, True, None]
    m.second_pass(blocks)
    assert [b.keep for b in blocks] == [False, False, True, True]


def test_table(spark, rows):
    data = [("jira_comments", 1, "**b** <b>x</b>", "x"), ("jira_comments", 1, "**b** <b>x</b>", "x"), ("jira_issues", 1, None, "x"), ("jira_issues", 2, "", "x")]
    df = spark.createDataFrame(data, "src_table string, row_id long, text string, markup string")
    assert rows(m.markup_found(df)) == [("jira_comments", 1, "html"), ("jira_comments", 1, "markdown")]
    assert sorted((r["row_id"], r["text"]) for r in m.cleaned(df).filter("src_table = 'jira_comments'").collect()) == [(1, "b x"), (1, "b x")]
    assert m.markup_found(df.filter("row_id > 9")).count() == 0
