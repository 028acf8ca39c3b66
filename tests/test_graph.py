import random

import pytest

from lodestone.operators import graph as g
from lodestone.plans import graph_queries
from lodestone.sources.graph import Graph

NODES = "stable_key string, identifier string, name string, kind string, is_test boolean"
EDGES = "src string, dst string, kind string, claim_class string, status string, confidence_bp int, fingerprint string, stale_reason string"


def graph(spark, nodes, edges):
    n = [(k, i, i, kind, test) for k, i, kind, test in nodes]
    e = [(s, t, k, c, st, bp, f"{s}:{k}:{t}", None) for s, t, k, c, st, bp in edges]
    return Graph(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))


def report(spark, gr, seed):
    seeds = spark.createDataFrame([(seed, seed)], "seed string, key string")
    return sorted((r["bucket"], r["identifier"]) for r in g.impact(gr, seeds).collect())


SYMBOL, TEST = ("s", "pay.charge", "code_symbol", False), ("t", "test_charge", "code_symbol", True)


def test_chain_reports_the_stale_end_and_stops_there(spark):
    gr = graph(
        spark,
        [SYMBOL, TEST, ("r", "REQ-1", "requirement", False), ("i", "INV-1", "invariant", False), ("f", "FEAT-1", "feature", False), ("d", "DEC-9", "decision", False)],
        [
            ("s", "r", "implements", "assertion", "active", 10000), ("s", "i", "enforces", "assertion", "stale", 10000), ("r", "f", "depends_on", "assertion", "active", 10000),
            ("r", "t", "covered_by", "assertion", "active", 10000), ("i", "d", "depends_on", "assertion", "active", 10000),
        ],
    )
    assert report(spark, gr, "s") == [("features", "FEAT-1"), ("implementation", "pay.charge"), ("invariants", "INV-1"), ("requirements", "REQ-1"), ("tests", "test_charge")]


def test_shared_test_does_not_bridge(spark):
    gr = graph(
        spark,
        [SYMBOL, TEST, ("a", "REQ-A", "requirement", False), ("b", "REQ-B", "requirement", False)],
        [("s", "a", "implements", "assertion", "active", 10000), ("a", "t", "covered_by", "assertion", "active", 10000), ("b", "t", "covered_by", "assertion", "active", 10000), ("s", "t", "calls", "fact", "active", 10000)],
    )
    assert ("requirements", "REQ-B") not in report(spark, gr, "s")
    assert ("requirements", "REQ-B") in report(spark, gr, "t")  # as the seed itself it leads on


def test_three_hops_rejected_and_inferences(spark):
    nodes = [SYMBOL] + [(f"q{n}", f"REQ-{n}", "requirement", False) for n in range(6)]
    chain = [("s", "q0", "implements", "assertion", "active", 10000)] + [(f"q{n}", f"q{n + 1}", "depends_on", "assertion", "active", 10000) for n in range(5)]
    assert [i for b, i in report(spark, graph(spark, nodes, chain), "s") if b == "requirements"] == ["REQ-0", "REQ-1", "REQ-2"]
    gone = [("s", "q0", "implements", "assertion", "rejected", 10000), ("s", "q1", "implements", "inference", "active", 6400)]
    assert report(spark, graph(spark, nodes, gone), "s") == [("implementation", "pay.charge")]
    guess = [("s", "q0", "implements", "inference", "active", 6500), ("q0", "q1", "depends_on", "inference", "active", 9000), ("q0", "q2", "depends_on", "assertion", "active", 10000)]
    assert [i for b, i in report(spark, graph(spark, nodes, guess), "s") if b == "requirements"] == ["REQ-0", "REQ-2"]


def test_contract_is_bounded_to_one_structural_hop(spark):
    gr = graph(
        spark,
        [SYMBOL, ("o", "other.reader", "code_symbol", False), ("db", "orders", "db_entity", False)],
        [("s", "db", "writes_to", "fact", "active", 10000), ("o", "db", "reads_from", "fact", "active", 10000)],
    )
    assert report(spark, gr, "s") == [("data_contracts", "orders"), ("implementation", "pay.charge")]


def test_resolve_prefers_exact(spark, rows):
    nodes = spark.createDataFrame([("k1", "a.b.run", "run", "x", False), ("k2", "c.run", "go", "x", False), ("k3", "d.e", "run", "x", False)], NODES)
    wanted = spark.createDataFrame([("run",), ("b.run",), ("e",), ("zzz",)], "query string")
    assert rows(g.resolve(nodes, wanted)) == [("b.run", "k1"), ("e", "k3"), ("run", "k1"), ("run", "k3")]


def test_distances_and_components_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"c{n}", f"c{n + 1}") for n in range(40)]
    around = {}
    for a, b in pairs:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)

    def reach(start):
        seen, todo, depth = {k: 0 for k in start}, list(start), 0
        while todo:
            depth += 1
            todo = [b for b in {b for a in todo for b in around.get(a, ())} if b not in seen]
            seen |= dict.fromkeys(todo, depth)
        return seen

    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = dict(map(tuple, g.distances(edges, spark.createDataFrame([("c5",), ("n1",)], "key string")).collect()))
    assert got == reach(["c5", "n1"])
    roots = dict(map(tuple, g.components(edges, "src", "dst").collect()))
    assert roots == {k: min(reach([k])) for k, v in around.items() if v - {k}}


def test_distances_raise_when_rounds_do_not_suffice(spark, rows, monkeypatch):
    edges, seeds = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string"), spark.createDataFrame([("a",)], "key string")
    monkeypatch.setattr(g, "ROUNDS", 3)
    assert rows(g.distances(edges, seeds)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    monkeypatch.setattr(g, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        g.distances(edges, seeds)
    assert rows(g.distances(edges, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_min_depth_has_no_bound(spark, rows, monkeypatch):
    nodes = [("n0", "n0", "domain_concept", False)] + [(f"n{n}", f"n{n}", "code_symbol", False) for n in range(1, 10)]
    gr = graph(spark, nodes, [(f"n{n}", f"n{n + 1}", "calls", "fact", "active", 10000) for n in range(9)])
    monkeypatch.setattr(graph_queries, "load", lambda *_: gr)
    assert rows(graph_queries.min_depth(spark, "")) == [(f"n{n}", n) for n in range(10)]


@pytest.mark.parametrize("levels,want", [(1, {("b", 1)}), (2, {("b", 1), ("c", 2)}), (3, {("b", 1), ("c", 2), ("d", 3)})])
def test_call_reach(spark, levels, want):
    gr = graph(spark, [], [(a, b, "calls", "fact", "active", 10000) for a, b in ("ab", "bc", "cd")])
    assert {(r["other"], r["depth"]) for r in g.call_reach(gr, levels).filter("key = 'a'").collect()} == want
