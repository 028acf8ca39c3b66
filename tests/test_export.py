import json
from pathlib import Path

import pytest

from lodestone.__main__ import main
from lodestone.sources import export
from tests.test_graph import graph


def test_diagram_is_bounded_and_quoted(spark):
    gr = graph(spark, [], [("hub", f"n{i:02}", "calls", "fact", "active", 1) for i in range(50)] + [('q"', "z", "calls", "fact", "active", 1)])
    got = {r["stable_key"]: r["diagram"] for r in export.mermaid(gr, 5).collect()}
    assert got["hub"].count("\n") == 5 and got["hub"].startswith('graph LR\n  a["hub"] -->|calls| n1["n00"]')
    assert "#quot;" in got['q"']


def test_manifest_is_repeatable(spark, tmp_path):
    gr = graph(spark, [], [])
    nodes = spark.createDataFrame([("i", "REQ-2", "n", "requirement", "public", "accepted", "b"), ("j", "REQ-1", "n", "requirement", "public", "accepted", "b"), ("k", "REQ-3", "n", "requirement", "internal", "accepted", "b")], "stable_key string, identifier string, name string, kind string, visibility string, status string, body string")
    ends = spark.createDataFrame([("r", "GET", "/a", "h1", None, None, "chi", 1, None), ("r", "GET", "/a", "h2", None, None, "chi", 2, None), ("r", "GET", "/b", "h", None, None, "chi", 1, 5)], "source_repo string, method string, path string, handler string, params array<struct<name:string,location:string>>, return_type string, framework string, published_at long, withdrawn_at long")
    texts = []
    for n in "ab":
        export.write_manifest(type(gr)(nodes, gr.edges), ends, str(tmp_path / n))
        texts.append(["".join(p.read_text() for p in sorted(Path(tmp_path / n / part).glob("part*"))) for part in ("documents", "endpoints")])
    assert texts[0] == texts[1]
    assert [json.loads(x)["identifier"] for x in texts[0][0].splitlines()] == ["REQ-1", "REQ-2"]
    assert [json.loads(x)["handler"] for x in texts[0][1].splitlines()] == ["h2"]


@pytest.mark.parametrize("args", [["t", "impact"], ["t", "status", "x"], ["t", "unknown"]])
def test_command_line_refuses(args):
    with pytest.raises(SystemExit):
        main(args)
