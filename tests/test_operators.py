import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ddl, text
from lodestone.operators import artifacts, diff, evaluate, packing, scoring, similarity
from lodestone.operators.skew import hot_keys, salted_join
from lodestone.sources.graph import Graph

COLUMNS = "entity string, name string, data_type string, nullable boolean, primary_key boolean, unique boolean, foreign_key string, default string"


def test_salted_join_equals_plain_join(spark, rows):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    hot = hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "n", floor=500)
    assert hot == ["hot"]
    assert rows(salted_join(big, small, "k", F.col("id"), hot).select("k", "id", "v")) == rows(big.join(small, "k", "left").select("k", "id", "v"))


def test_schema_changes_keep_the_third_value(spark):
    col = lambda name, kind="int", null=None, pk=False, uq=False, fk=None, default=None: ("t", name, kind, null, pk, uq, fk, default)
    before = [col("same"), col("gone"), col("old_name"), col("typed"), col("tight"), col("loose", null=False), col("unknown", null=False), col("uq"), col("was", uq=True), col("fk"), col("pk"), col("df")]
    after = [
        col("same"), col("new_name"), col("typed", "text"), col("tight", null=False), col("loose", null=True), col("unknown"), col("uq", uq=True), col("was"), col("fk", fk="x.id"), col("pk", pk=True),
        col("df", default="1"),
    ]
    renames = spark.createDataFrame([("t", "old_name")], "entity string, previous string")
    got = {(r["column"], r["change"], r["destructive"]) for r in diff.schema_changes(spark.createDataFrame(before, COLUMNS), spark.createDataFrame(after, COLUMNS), renames).collect()}
    assert got == {
        ("gone", "column_dropped", True), ("new_name", "column_added", False), ("typed", "column_type_changed", True), ("tight", "nullability_tightened", True),
        ("loose", "nullability_relaxed", False), ("uq", "unique_added", False), ("was", "unique_removed", True), ("fk", "foreign_key_changed", True), ("pk", "primary_key_changed", True), ("df", "default_changed", False),
    }


def test_replay_and_divergence(spark, rows):
    ops = spark.createDataFrame(
        [("1", 0, "t", "add", "a", None), ("1", 1, "t", "add", "b", None), ("2", 0, "t", "drop", "a", None), ("3", 0, "t", "rename", "b", "c"), ("4", 0, "u", "add", "z", None)],
        "path string, position int, entity string, op string, column string, new_name string",
    )
    left = diff.replay_columns(ops)
    assert rows(left) == [("t", "c"), ("u", "z")]
    models = spark.createDataFrame([("t", "c"), ("t", "d"), ("only", "x")], "entity string, column string")
    assert rows(diff.schema_divergence(models, left)) == [("t", "d", "expected_by_orm_only")]


def test_three_way_merge(spark, rows):
    side = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    base, ours, theirs = side(("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1")), side(("a", "1"), ("b", "2"), ("c", "1"), ("d", "2"), ("f", "9")), side(("a", "1"), ("b", "1"), ("c", "3"), ("d", "3"), ("e", "1"), ("f", "9"))
    assert rows(diff.three_way_merge(base, ours, theirs, "k", "v")) == [
        ("a", "unchanged", "1"), ("b", "ours", "2"), ("c", "theirs", "3"), ("d", "ambiguous", None), ("e", "ours", None), ("f", "same", "9")
    ]


def test_api_changes(spark, rows):
    kind = "method string, path string, params array<struct<name:string,location:string>>, return_type string, framework string"
    before = spark.createDataFrame([("GET", "/a", [("x", "path"), ("y", "query")], "list", "chi"), ("GET", "/b", [], None, "chi"), ("GET", "/c", None, None, "chi")], kind)
    after = spark.createDataFrame([("GET", "/a", [("x", "query"), ("z", "query")], None, "axum"), ("GET", "/c", None, None, "chi"), ("PUT", "/d", [], None, "chi")], kind)
    got = {(r["method"], r["path"]): (r["kind"], r["destructive"], r["details"]) for r in diff.api_changes(before, after, ["method", "path"]).collect()}
    assert got == {
        ("GET", "/a"): ("contract_modified", True, "removed parameter y; changed parameter x; added parameter z; return type changed from list to unknown; framework changed from chi to axum"),
        ("GET", "/b"): ("removed", True, ""), ("PUT", "/d"): ("added", False, ""),
    }


def test_packing_against_greedy(spark):
    rng = random.Random(4)
    items = [(rng.choice("ab"), n, rng.randrange(0, 40), rng.random()) for n in range(600)]
    got = {}
    df = spark.createDataFrame(items, "g string, id int, size int, p double")
    for r in packing.pack(df, "g", "size", [F.col("p").desc()], "id", 100).collect():
        got.setdefault(r["g"], set()).add(r["id"])
    for group in "ab":
        room, taken = 100, set()
        for _, n, s, _ in sorted((i for i in items if i[0] == group and i[2]), key=lambda i: -i[3]):
            if s <= room:
                room, taken = room - s, taken | {n}
        assert got[group] == taken


def test_overlap_pairs_and_clusters_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(f"d{n:03}", rng.choice("xy"), [f"w{min(rng.randrange(25), rng.randrange(25))}" for _ in range(rng.randrange(0, 7))]) for n in range(150)]
    df = spark.createDataFrame(docs, "k string, g string, t array<string>")
    classes = {}
    for k, g, t in sorted(docs):
        if t:
            classes.setdefault((g, frozenset(t)), k)
    want = {(g, *sorted((a, b))) for (g, s), a in classes.items() for (h, t), b in classes.items() if g == h and a < b and len(s & t) * 5 >= min(len(s), len(t)) * 3}
    got = [tuple(r) for r in similarity.overlap_pairs(df, "k", "g", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    clusters = dict(map(tuple, similarity.clusters(df, "k", "g", "t").collect()))
    assert set(clusters) == {k for k, _, t in docs if t}
    rep = {k: classes[(g, frozenset(t))] for k, g, t in docs if t}
    assert all(clusters[a] == clusters[b] for _, a, b in want) and all(clusters[k] == clusters[r] for k, r in rep.items())


@pytest.mark.parametrize(
    "source,want",
    [
        ("see PAY-317, #482 and !9 at https://x.example/browse/PAY-317).", {("ticket_key", "PAY-317"), ("issue_number", "482"), ("merge_request_number", "9"), ("url", "https://x.example/browse/PAY-317")}),
        ("ABCDEFGHIJK-1 A-1 PAY-1234567 xPAY-1 PAY-1b a#1 éPAY-2", set()),
        ("", set()),
    ],
)
def test_references(spark, source, want):
    df = spark.createDataFrame([(source,)], "t string").select(F.inline(text.references(F.col("t"))))
    assert {tuple(r) for r in df.collect()} == want


def test_text_expressions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert sorted(one(text.terms(F.lit("chargeInvoices dedupe class2Go Straßen glass")))) == sorted(["charge", "invoice", "dedup", "class2", "straßen", "glass"])
    assert sorted(one(text.requirement_terms(F.lit("The refund MUST be for Äpfel")))) == ["refund", "Äpfel"]
    assert [one(text.path_template(F.lit(u))) for u in ("https://h", "https://h?x", "https://h/a/{b}/c?d#e", "/x/{y}", "relative/x", None)] == ["/", "/", "/a/{param}/c", "/x/{param}", None, None]
    assert one(text.estimate_tokens(F.lit("12345"))) == 2 and one(text.truncate_to_tokens(F.lit("123456789"), F.lit(2))) == "12345678…"
    assert one(text.derived_title(F.lit("First one. Second."))) == "First one." and len(one(text.derived_title(F.lit("x" * 99)))) == 81


def test_lexical_scores(spark, rows):
    docs = spark.createDataFrame([("a", "invoice", "x"), ("b", "other", "invoices paid"), ("c", "none", None)], "k string, name string, body string")
    assert rows(text.lexical_scores(docs, ["invoice"], "k", {"name": 4, "body": 1})) == [("a", 200), ("b", 50)]  # N + 1 = 4, df = 2


def test_ddl(spark):
    sql = """-- +goose Up
    CREATE TABLE IF NOT EXISTS public.Orders (id bigint PRIMARY KEY, total numeric(10, 2) NOT NULL DEFAULT 0, note text, cust int REFERENCES customers(id), UNIQUE (note)); -- ; in a comment
    ALTER TABLE orders ADD COLUMN paid boolean DEFAULT now(), DROP COLUMN IF EXISTS note, RENAME COLUMN cust TO customer, ALTER COLUMN total SET NOT NULL;
    CREATE UNIQUE INDEX ix ON orders (paid); DROP TABLE IF EXISTS a, b; SELECT ';' FROM x;
    -- +goose Down
    DROP TABLE orders;"""
    df = spark.createDataFrame([(1, sql), (2, None), (3, "")], "id long, t string")
    got = [(r["op"], r["entity"], r["column"], r["data_type"], r["nullable"]) for r in ddl.operations(df, "id", "t").orderBy("id").collect()]
    assert got == [
        ("create", "public.orders", None, None, None), ("add", "public.orders", "id", "bigint", False), ("add", "public.orders", "total", "numeric(10,2)", False),
        ("add", "public.orders", "note", "text", None), ("add", "public.orders", "cust", "int", None), ("add", "orders", "paid", "boolean", None), ("drop", "orders", "note", None, None),
        ("rename", "orders", "cust", None, None), ("alter", "orders", "total", None, False), ("create_index", "orders", "ix", None, None), ("drop_table", "a", None, None, None), ("drop_table", "b", None, None, None),
    ]


def test_kappa(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 0)] + [(1, 1)] * 3
    got = evaluate.kappa(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a int, b int")).first()
    assert (got["n"], got["observed"], got["expected"], got["kappa"]) == (8, 0.75, 0.5, 0.5)
    perfect = evaluate.kappa(spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "i int, a int, b int")).first()
    assert (perfect["observed"], perfect["expected"], perfect["kappa"]) == (1.0, 1.0, None)
    assert evaluate.kappa(spark.createDataFrame([], "i int, a int, b int")).first()["kappa"] is None


def test_precision_counts_unrated_as_miss(spark, rows):
    df = spark.createDataFrame([("m", 5.0, "a", True), ("m", 4.0, "b", None), ("m", 3.0, "c", True)], "g string, s double, i string, ok boolean")
    assert rows(evaluate.precision_at(df, "g", "s", "i", F.col("ok"), 2)) == [("m", 2, 1, 0.5)]


def test_scope_ladder(spark):
    arts = [("g1", "git", "commit", None), ("g2", "git", "commit", None), ("m1", "gitlab", "merge_request", None), ("m2", "gitlab", "merge_request", None), ("K-1", "jira", "issue", None), ("K-2", "jira", "issue", None), ("K-9", "jira", "issue", None), ("c1", "jira", "comment", "K-2"), ("c2", "jira", "comment", "K-9"), ("x", "wiki", "page", None)]
    links = spark.createDataFrame([("g1", "K-1"), ("m1", "K-2"), ("g2", "K-9")], "id string, issue string")
    depths = spark.createDataFrame([("K-1", 0), ("K-2", 1)], "key string, depth int")
    plan = {r["id"]: (r["disposition"], r["reason"]) for r in artifacts.scope_plan(spark.createDataFrame(arts, "id string, provider string, kind string, parent string"), links, depths).collect()}
    assert plan == {
        "g1": ("keep", "business_anchored_git"), "g2": ("prune", "no_business_anchor"), "m1": ("keep", "repository_linked_merge_request"), "m2": ("prune", "no_business_anchor"), "K-1": ("keep", "direct_jira_reference"),
        "K-2": ("keep", "related_jira_issue:1"), "K-9": ("prune", "jira_not_referenced_by_repository"), "c1": ("keep", "retained_parent"), "c2": ("prune", "parent_not_retained"), "x": ("prune", "unsupported_in_business_scope"),
    }


def test_sweep_and_related(spark, rows):
    changes = spark.createDataFrame([("c1", "a.py"), ("c2", "a.py"), ("c2", "b.py"), ("c2", "c.py")], "commit string, path string")
    symbols = spark.createDataFrame([("a.py", "s1"), ("b.py", "s2")], "file_path string, stable_key string")
    assert rows(artifacts.symbol_links(changes, symbols, spark.createDataFrame([(2,)], "threshold long"))) == [("c1", "s1")]
    links = spark.createDataFrame([("A", "B"), ("C", "B"), ("C", "D")], "a string, b string")
    assert rows(artifacts.related(spark.createDataFrame([("A",)], "key string"), links, 2)) == [("A", 0), ("B", 1), ("C", 2)]


def test_link_candidates(spark):
    nodes = spark.createDataFrame(
        [
            ("s1", "billing.charge", "charge", "code_symbol", False, "a.py", "def charge", None), ("s2", "billing.refund_invoice_total_amount", "refund", "code_symbol", False, "a.py", "def refund", None),
            ("s3", "far.refund_invoice_total_amount", "refund", "code_symbol", False, "b.py", None, None), ("t", "test_x", "test_x", "code_symbol", True, "t.py", None, None), ("r", "REQ-1", "REQ-1", "requirement", False, None, None, "refund invoice total amount"),
        ],
        "stable_key string, identifier string, name string, kind string, is_test boolean, file_path string, signature string, body string",
    )
    edges = spark.createDataFrame(
        [("s1", "r", "implements", "assertion", "active"), ("r", "t", "covered_by", "assertion", "active"), ("s2", "t", "calls", "fact", "active"), ("s1", "s2", "calls", "fact", "active")],
        "src string, dst string, kind string, claim_class string, status string",
    )
    got = [(r["symbol"], r["lexical"], r["structural"], r["test"], r["score"]) for r in scoring.link_candidates(Graph(nodes, edges)).collect()]
    assert got == [("s2", 3500, 3000, 1500, 8000)]
    backed = spark.createDataFrame([("r", "s3")], "intent string, symbol string")
    assert {(r["symbol"], r["score"]) for r in scoring.link_candidates(Graph(nodes, edges), 4500, backed).collect()} == {("s2", 8000), ("s3", 4500)}
