import importlib.util
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from lodestone.api import Engine
from lodestone.operators import context
from tests.test_graph import graph

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
REPO = Path(__file__).resolve().parents[1]


@needs_data
def test_verbs(spark):
    e = Engine(spark, DATA)
    node = e.graph.nodes.filter("kind = 'db_entity'").orderBy("stable_key").first()
    assert e.find(node["stable_key"]).count() == 1
    assert e.impact(node["stable_key"]).filter("bucket = 'data_contracts'").count() >= 1
    assert e.explain(node["stable_key"]).columns[0] == "stable_key"
    assert e.status().count() == 1 and e.freshness().count() > 0
    with pytest.raises(LookupError):
        e.impact("no such thing")
    with pytest.raises(ValueError):
        e.context("task", 0)
    pack = e.context("validate the invoice snapshot policy", 400)
    assert pack.count() > 0 and pack.agg({"tokens": "sum"}).first()[0] <= 320
    assert e.find_requirements("invoice").count() <= 20
    assert e.trace("GET /nowhere").count() == 0 and e.review(0, 2000).count() >= 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["seed", "bucket", "stable_key", "identifier"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_stands_without_the_text_subpackage():
    code = "import sys; sys.modules['lodestone.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('lodestone.llm') else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and not any(n.startswith('p7') for n in q); assert not [m for m in sys.modules if m.startswith('lodestone.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    assert importlib.util.find_spec("lodestone") is not None


def test_pack_prefers_invariants_and_skips_what_does_not_fit(spark):
    nodes = [("i", "INV-pay", "invariant", False), ("r", "REQ-pay", "requirement", False), ("s", "pay", "code_symbol", False), ("far", "other", "code_symbol", False)]
    edges = [("s", "i", "enforces", "assertion", "active", 10000), ("s", "r", "implements", "assertion", "active", 10000)]
    gr = graph(spark, nodes, edges)
    full = gr.nodes.selectExpr("*", "cast(null as string) as status", "repeat('word ', case when stable_key = 'r' then 200 else 1 end) as body", "cast(null as string) as signature", "cast(null as string) as file_path", "cast(null as string) as symbol_kind")
    got = [(r["stable_key"], r["priority"]) for r in context.context_pack(type(gr)(full, gr.edges), ["pay"], 100).collect()]
    assert got == [("i", "invariant"), ("s", "direct_implementation")]
