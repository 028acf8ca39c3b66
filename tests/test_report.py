import json
import os

import pytest

from lodestone import report, tools
from lodestone.api import Engine

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    if not os.path.exists(SMALL):
        pytest.skip("no tables")
    return Engine(spark, SMALL)


def test_site_is_written_whole_and_refuses_other_folders(spark, tmp_path):
    parts = {"a": spark.createDataFrame([(2, "<b>"), (1, None)], "k int, v string"), "none": spark.createDataFrame([], "k int")}
    out = tmp_path / "site"
    report.write_site(parts, str(out))
    report.write_site(parts, str(out))
    assert [json.loads(x) for x in (out / "a.jsonl").read_text().splitlines()] == [{"k": 1, "v": None}, {"k": 2, "v": "<b>"}]
    assert "&lt;b&gt;" in (out / "a.html").read_text() and (out / "none.html").exists()
    other = tmp_path / "other"
    other.mkdir()
    (other / "mine.txt").write_text("x")
    with pytest.raises(FileExistsError):
        report.write_site(parts, str(other))
    assert (other / "mine.txt").read_text() == "x" and not [p for p in os.listdir(tmp_path) if p.startswith(".report")]


def test_datasets(engine, spark):
    parts = report.datasets(spark, SMALL)
    assert parts["catalog"].count() and parts["status"].count() == 1
    ends = {r["stable_key"] for r in parts["catalog"].collect()}
    assert all(r["src"] in ends and r["dst"] in ends for r in parts["graph"].collect())


def test_tools(engine):
    ask = lambda method, **params: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    lines = [ask("initialize"), "", ask("tools/list"), ask("tools/call", name="status"), ask("tools/call", name="impact", arguments={}), ask("tools/call", name="nothing"), "{", ask("other")]
    got = [json.loads(x) for x in tools.serve(engine, lines)]
    assert len(got) == 7 and len(got[1]["result"]["tools"]) == len(tools.TOOLS)
    assert json.loads(got[2]["result"]["content"][0]["text"])[0]["claims"] > 0
    assert [("error" in g) for g in got] == [False, False, False, True, True, True, True] and "target" in got[3]["error"]["message"]


def test_verbs(engine, spark):
    assert engine.coverage().count() and engine.gaps().columns == ["stable_key", "identifier", "kind"]
    assert set(r["health"] for r in engine.health().collect()) <= {"needs_index", "needs_attention", "needs_context", "needs_mappings", "ready"}
    assert engine.repairs().columns == ["document", "symbol", "class", "target"] and engine.neighbors("2025-01-01").count()
    before = engine.graph.edges.count()
    one = engine.graph.edges.filter("claim_class = 'inference'").selectExpr("fingerprint", "'accept' as verdict").limit(1)
    assert engine.verify(one, 9).count() == before + one.count()
