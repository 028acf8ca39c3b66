from pyspark.sql import functions as F

from lodestone.operators import rows as rw
from lodestone.operators.trace import Tracer, size


def test_controlled_calls_and_kinds(spark, rows):
    df = spark.createDataFrame([([("b", 2), ("a", 9), ("a", 3), ("c", 5)], [(1, 3), (8, 9)]), ([], []), (None, [(1, 2)])], "calls array<struct<name:string,line:int>>, regions array<struct<lo:int,hi:int>>")
    assert [r[0] for r in df.select(rw.controlled(F.col("calls"), F.col("regions"))).collect()] == [["a", "b"], [], None]
    k = spark.createDataFrame([("ticket_key", "issue"), ("ticket_key", "commit"), ("url", "commit"), ("other", "issue"), (None, "issue")], "r string, a string")
    assert [r[0] for r in k.select(rw.may_match(F.col("r"), F.col("a"))).collect()] == [True, False, True, False, False]


def test_unique_and_first(spark, rows):
    calls = spark.createDataFrame([("x", "m.a"), ("x", "n.a"), ("x", "m.b"), ("x", "m.b")], "caller string, callee string")
    names = spark.createDataFrame([("m.a", "a"), ("n.a", "a"), ("m.b", "b")], "callee string, name string")
    assert rows(rw.unique_callees(calls, names)) == [("x", "b", "m.b")]
    many = spark.createDataFrame([("s", f"e{n:02d}") for n in range(12)] + [("s", "e01")], "k string, t string")
    assert rows(rw.effects_of(many, "k", F.col("t"))) == [("s", "; ".join(f"e{n:02d}" for n in range(8)))]


def test_merges_and_links(spark, rows):
    pairs = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c1"), ("d", "c2"), ("e", "c2")], "member string, cluster string")
    yes = spark.createDataFrame([("b",), ("c",), ("c",), ("d",)], "member string")
    assert rows(rw.merges(pairs, yes)) == [("c1", "b", "c")]
    link = "src string, target string, kind string, locator string"
    now = spark.createDataFrame([("s", None, "k", "1"), ("s", "t", "k", "1"), ("u", "t", "k", "1")], link)
    new = spark.createDataFrame([("s", None, "k", "2"), ("s", None, "k", "3"), ("v", "t", "k", "2")], link)
    assert rows(rw.upsert_links(now, new)) == sorted([("s", "t", "k", "1"), ("u", "t", "k", "1"), ("s", None, "k", "3"), ("v", "t", "k", "2")], key=str)
    assert rows(rw.upsert_links(now.limit(0), new.limit(0))) == []


def test_failures_and_checks(spark, rows):
    changes = spark.createDataFrame([("modified", "a", "a"), ("added", None, "b"), ("renamed", "c", "d"), ("deleted", "e", None), ("added", None, "f")], "op string, old_path string, new_path string")
    failed = spark.createDataFrame([("a",), ("b",), ("d",)], "path string")
    assert rows(rw.after_failures(changes, failed)) == sorted([("deleted", "a", None), ("deleted", "c", None), ("deleted", "e", None), ("added", None, "f")], key=str)
    checks = spark.createDataFrame([("x", "contains", "v", None), ("x", "absent", "v", None), ("x", "at_least", None, 2), ("y", "equals", None, 0), ("x", "odd", "v", 1)], "case string, kind string, value string, number int")
    results = spark.createDataFrame([("x", "v"), ("x", "v"), ("x", "w")], "case string, value string")
    assert rows(rw.evaluated(checks, results)) == [("x", "absent", False), ("x", "at_least", True), ("x", "contains", True), ("x", "odd", False), ("y", "equals", True)]


def test_samples_and_orders(spark, rows):
    import hashlib

    items = [("g", f"i{n}", n % 4 == 0) for n in range(11)]
    df = spark.createDataFrame(items, "g string, item string, rated boolean")
    got = rows(rw.review_sample(df, "g", "item", F.col("rated"), "s:"))
    order = sorted(items, key=lambda x: hashlib.sha256(f"s:{x[1]}".encode()).hexdigest())[:3]
    assert got == sorted((g, i, n + 1) for n, (g, i, r) in enumerate(order) if not r)
    frozen = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "a")], "group string, place int, item string")
    now = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 3, "c"), ("h", 1, "z")], "group string, place int, item string")
    assert rows(rw.extended(frozen, now)) == [("g", True, 2), ("h", False, 1)]


def test_heads_and_texts(spark, rows):
    r = spark.createDataFrame([("worktree@ABCD",), ("abcdef12",), ("abc",), ("main",), (None,)], "r string").select(rw.head_reference(F.col("r")).alias("h")).select("h.commit", "h.worktree")
    assert [tuple(x) for x in r.collect()] == [("abcd", True), ("abcdef12", False), (None, None), (None, None), (None, None)]
    cols = spark.createDataFrame([("t", "id", "int", False, True, False), ("t", "n", "text", None, False, True)], "entity string, name string, data_type string, nullable boolean, primary_key boolean, unique boolean")
    assert rows(rw.rendered_columns(cols)) == [("t", "t (id int PK NOT NULL, n text UNIQUE)")]
    said = spark.createDataFrame([(875, 0, 1500)], "lexical int, structural int, test int").select(rw.told(["lexical", "structural", "test"]))
    assert said.first()[0] == "shared terms (875), a covering test calls it (1500)"


def test_trace_of_a_wide_handler_is_the_least_part(spark):
    edges = [("a", "h", "E", "exposes", "active")] + [("a", "h", f"t{n:03d}", "reads_from", "active") for n in range(200)]
    t = Tracer(
        spark.createDataFrame(edges, "service string, src string, dst string, kind string, status string"), spark.createDataFrame([], "service string, key string, method string, route string"),
        spark.createDataFrame([], "service string, key string, method string, route string"),
    )
    got = t.trace("a", "E")
    assert [r["target"] for r in got.filter("kind = 'reads_from'").collect()] == [f"t{n:03d}" for n in range(49)] and size(got) == 51
