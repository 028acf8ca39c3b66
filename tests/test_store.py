import pytest
from pyspark.sql import functions as F

from lodestone.functions import analyze, scan
from lodestone.operators import coverage, store
from lodestone.operators.trace import Budget, Tracer
from lodestone.session import scratch
from tests.test_graph import graph

HIST = "k string, v string, valid_from long, valid_to long"


def test_publish_is_all_or_nothing(spark, rows):
    s = store.SnapshotStore(spark, scratch(spark, "store"))
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert s.version() == -1
    assert s.publish({"a": one(1), "b": one(2)}) == 0
    assert s.publish({"a": one(3)}, expected=0) == 1
    assert rows(s.read("a")) == [(3,)] and rows(s.read("b")) == [(2,)]
    with pytest.raises(RuntimeError):
        s.publish({"a": one(9)}, expected=0)
    assert rows(s.read("a")) == [(3,)]


def test_scd2_merge(spark, rows):
    history = spark.createDataFrame([("same", "1", 1, None), ("changed", "1", 1, None), ("gone", "1", 2, None), ("closed", "1", 1, 3), ("rewritten", "1", 5, None), ("undone", "1", 1, 5), ("undone", "2", 5, None)], HIST)
    state = spark.createDataFrame([("same", "1"), ("changed", "2"), ("new", "1"), ("rewritten", "9"), ("undone", "1"), ("new", "1")], "k string, v string")
    assert rows(store.scd2_merge(history, state, ["k"], ["v"], 5)) == sorted([
        ("same", "1", 1, None), ("changed", "1", 1, 5), ("changed", "2", 5, None), ("gone", "1", 2, 5), ("closed", "1", 1, 3), ("new", "1", 5, None), ("rewritten", "9", 5, None), ("undone", "1", 1, None)], key=str)
    once = store.scd2_merge(history, state, ["k"], ["v"], 5)
    assert rows(store.scd2_merge(once, state, ["k"], ["v"], 5)) == rows(once)  # taking it in twice changes nothing


def test_merges(spark, rows):
    df = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    assert rows(store.upsert(df(("a", 9), ("b", 1)), df(("a", 1), ("c", 1), ("c", 2)), ["k"], ["n"])) == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(store.create_missing(df(("a", 1)), df(("a", 5), ("b", 2), ("b", 2)), ["k"])) == [("a", 1), ("b", 2)]
    assert rows(store.reconcile(df(("a", 1), ("b", 1), ("z", 2)), df(("a", 0)), ["k"], F.col("n") == 1)) == [("a", 1), ("z", 2)]
    assert rows(store.replace_of(df(("a", 1), ("a", 2), ("b", 3)), df(("a", 7), ("a", 7)), ["k"])) == [("a", 7), ("b", 3)]
    assert rows(store.unreferenced(df(("a", 1), ("b", 2)), "k", df(("a", 1), (None, 1)), "k")) == [("b", 2)]


def test_retire(spark, rows):
    nodes = spark.createDataFrame([("s", None), ("t", 3), ("u", None)], "stable_key string, retired_commit long")
    edges = spark.createDataFrame([("s", "u", "fact", "active", None, None), ("u", "s", "assertion", "active", None, None), ("u", "u", "fact", "active", None, None), ("s", "u", "fact", "active", 2, None)], "src string, dst string, claim_class string, status string, valid_to long, stale_reason string")
    n, e = store.retire(nodes, edges, spark.createDataFrame([("s",), ("t",)], "stable_key string"), 9)
    assert rows(n) == [("s", 9), ("t", 3), ("u", None)]
    assert rows(e) == sorted([("s", "u", "fact", "active", 9, None), ("u", "s", "assertion", "stale", None, "implementation_changed"), ("u", "u", "fact", "active", None, None), ("s", "u", "fact", "active", 2, None)], key=str)


def test_downstream_and_gaps(spark, rows):
    calls = [(a, b, "calls", "fact", "active", 10000) for a, b in ("ab", "bc", "cd", "de")]
    gr = graph(spark, [], calls + [("b", "T", "writes_to", "fact", "active", 1), ("c", "T", "reads_from", "fact", "active", 1), ("d", "U", "writes_to", "fact", "stale", 1), ("a", "x", "exposes", "fact", "active", 1)])
    assert rows(coverage.effects(gr)) == [("b", 5), ("c", 2)]
    assert rows(coverage.downstream(gr)) == [("a", 8), ("b", 5), ("c", 2), ("d", 1)]
    assert rows(coverage.entry_reach(gr)) == [("b", 1), ("c", 1), ("d", 1), ("e", 1)]
    points = spark.createDataFrame([("p1", "c", 4, 0, 0, 0, True, False), ("p2", "z", 0, 0, 9, 0, True, False), ("p3", "c", 4, 0, 0, 0, True, True)], "anchor string, key string, condition int, direct int, imbalance int, sdk int, shaped boolean, routine boolean")
    scores = coverage.decision_scores(gr, points)
    assert rows(scores) == [("p1", "c", 8, True), ("p2", "z", 5, False), ("p3", "c", 8, False)]
    records = spark.createDataFrame([("p1", "dismissed", "h1", "h2")], "anchor string, state string, revision_hash string, current_hash string")
    none = spark.createDataFrame([], "anchor string, document string")
    assert rows(coverage.gap_states(scores, records, none)) == [("p1", "reopened")]
    assert rows(coverage.gap_states(scores, records, spark.createDataFrame([("p1", "d"), ("p1", "d")], "anchor string, document string"))) == [("p1", "explained")]


EDGES = "service string, src string, dst string, kind string, status string"


def test_trace_reasons(spark):
    edges = spark.createDataFrame(
        [("a", "h", "E1", "exposes", "active"), ("a", "h", "t1", "reads_from", "active"), ("a", "h", "t2", "writes_to", "stale"), ("a", "h", "c1", "calls_external", "active"), ("a", "h", "c2", "calls_external", "active"), ("a", "h", "c3", "calls_external", "active"),
         ("b", "k", "E2", "exposes", "active"), ("b", "k", "d1", "calls_external", "active"), ("a", "old", "E9", "exposes", "stale")], EDGES)
    calls = spark.createDataFrame([("a", "c1", "GET", "/b"), ("a", "c2", "GET", None), ("a", "c3", "PUT", "/two"), ("b", "d1", "GET", "/a")], "service string, key string, method string, route string")
    ends = spark.createDataFrame([("b", "E2", "GET", "/b"), ("a", "E1", "GET", "/a"), ("b", "E3", "PUT", "/two"), ("c", "E4", "PUT", "/two")], "service string, key string, method string, route string")
    walk = lambda t, k="E1", b=None: [(r["kind"], r["target"], r["stopped"]) for r in t.trace("a", k, b).collect()]
    t = Tracer(edges, calls, ends)
    assert walk(t) == [
        ("endpoint", "E1", None), ("handler", "h", None), ("reads_from", "t1", None), ("call", "c1", None), ("endpoint", "E2", None), ("handler", "k", None), ("call", "d1", None), ("endpoint", "E1", "cycle"),
        ("call", "c2", "unmatched"), ("call", "c3", "ambiguous"),
    ]
    assert walk(t, "E9") == [("endpoint", "E9", "retired_fact")]
    assert walk(t, b=Budget(nodes=2))[-1][2] == "node_cap_reached"
    assert walk(t, b=Budget(branches=1))[-1] == ("call", "c3", "branch_cap_reached")
    assert ("call", "c1", "service_transition_cap_reached") in walk(t, b=Budget(transitions=0))
    over = spark.createDataFrame([("PUT", "/two", "c")], "method string, route string, neighbor string")
    assert ("endpoint", "E4", "retired_fact") in walk(Tracer(edges, calls, ends, over))


RUST = '''use a::b;
/// fn fake() {}
pub struct Repo { x: u8 }
impl Store for Repo {
    pub fn save(&self, s: &str) -> Result<(), E> { let q = "INSERT INTO orders (id) VALUES (1)"; helper(q); self.log("}") }
}
fn helper<T: Fn(u8)>(x: T) {}
#[test]
fn checks() { helper(1) }
'''
GO = '''package p

type Repo struct { x int }

func (r *Repo) Save(s string) error {
	q := `SELECT id FROM orders`
	return helper(q) // }
}

func helper(x string) error { return nil }
'''
PY = '''def f(a, b=None):
    if not a:
        return None
    if a.total > 3 and b:
        charge(a)
    else:
        refund(a)
    try:
        x = b or 5
    except ValueError:
        raise
    match x:
        case 1: one()
        case _: other()
'''


def test_scanners(spark):
    df = spark.createDataFrame([(1, "src/shop/repo.rs", RUST), (2, "src/shop/repo.go", GO), (3, "x.rs", "")], "file_id long, path string, text string")
    got = {r["canonical"]: r for r in analyze.symbols(df).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {
        "shop::repo::Repo": "class", "shop::repo::Repo::save": "method", "shop::repo::helper": "function", "shop::repo::checks": "test", "shop.Repo": "class", "shop.Repo.Save": "method", "shop.helper": "function"}
    assert got["shop::repo::Repo::save"]["writes"] == ["orders"] and got["shop.Repo.Save"]["reads"] == ["orders"]
    assert got["shop.Repo.Save"]["calls"] == ["helper"] and (got["shop.Repo.Save"]["start_line"], got["shop.Repo.Save"]["end_line"]) == (5, 8)


def test_decision_points(spark):
    df = spark.createDataFrame([(1, "shop/f.py", PY), (2, "bad.py", "def ("), (3, "n.py", None)], "file_id long, path string, text string")
    got = [(r["kind"], r["condition"], r["branches"], r["routine"]) for r in scan.decision_points(df).orderBy("line", "kind").collect()]
    assert got == [("guard", "not a", 1, True), ("branch", "a.total > 3 and b", 2, False), ("default_value", "b or 5", 1, False), ("error", "ValueError", 1, True), ("arm", "1", 2, False), ("arm", "_", 2, False)]
