import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import agents, anchors, columns, neighborhood as nb, planner, repair, review, snapshots
from lodestone.sources.graph import Graph

SYM = "key string, language string, canonical string, name string, kind string, file_path string, signature string, body string, shape string, extra string"
CHANGES = "op string, old_path string, new_path string"


def sym(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SYM)


def serial(prior, defs, changes):
    """The planner, one definition after the other."""
    known = {p[5] for p in prior}
    replaced = {(n if op == "added" else o) for op, o, n in changes if op != "added" or n in known}
    before = {n: (o or n) for op, o, n in changes if n}
    one = lambda rows: rows[0][0] if len(rows) == 1 else None
    exact = {d[0]: one([p for p in prior if (p[1], p[2], p[4]) == (d[1], d[2], d[4])]) for d in defs}
    used, out = {k for k in exact.values() if k}, {}
    paths = {}
    for d in defs:
        paths.setdefault(before[d[5]], set()).add(d[2])
    for d in sorted(defs, key=lambda d: d[0]):
        here = before[d[5]]
        named = one([p for p in prior if p[5] == here and (p[3], p[4], p[6]) == (d[3], d[4], d[6])])
        shaped = one([p for p in prior if p[5] in replaced and (p[1], p[4], p[3], p[8]) == (d[1], d[4], d[3], d[8])])
        gone = [p for p in prior if p[5] == here and p[2] not in paths[here] and (p[4], p[8]) == (d[4], d[8])]
        old = {p[2] for p in prior if p[5] == here}
        fresh = [x for x in defs if before[x[5]] == here and x[2] not in old and (x[4], x[8]) == (d[4], d[8])]
        renamed = one(gone) if d in fresh and len(fresh) == 1 else None
        wishes = [exact[d[0]], named, shaped, renamed]
        base = f"symbol:{d[1]}:{d[2]}:{d[4].capitalize()}"
        key = next((k for k in wishes if k and k not in used), None)
        if key is None:
            key = base
            if not any(wishes):
                n = 1
                while key in used:
                    n += 1
                    key = f"{base}#{n}"
        used.add(key)
        out[d[0]] = key
    return out


@pytest.mark.parametrize("seed", range(3))
def test_planner_against_one_definition_after_the_other(spark, seed):
    rng = random.Random(seed)
    prior, defs = [], []
    for n in range(60):
        c = f"m.n{rng.randrange(25)}"
        prior.append((f"k{n}", "python", c, c[-2:], rng.choice(["method", "function"]), f"f{rng.randrange(6)}", rng.choice(["s", "t", None]), f"b{rng.randrange(9)}", f"h{rng.randrange(6)}"))
    for n in range(60):
        c = f"m.n{rng.randrange(30)}"
        defs.append((f"{n:03d}", "python", c, c[-2:], rng.choice(["method", "function"]), f"f{rng.randrange(4)}", rng.choice(["s", "t", None]), f"b{rng.randrange(9)}", f"h{rng.randrange(6)}"))
    changes = [("modified", "f0", "f0"), ("modified", "f1", "f1"), ("renamed", "f4", "f2"), ("added", None, "f3"), ("deleted", "f5", None)]
    p = sym(spark, *prior)
    d = sym(spark, *defs).withColumnRenamed("key", "ord")
    got = planner.plan_symbols(p, d, spark.createDataFrame(changes, CHANGES))
    assert {r["ord"]: r["key"] for r in got.collect()} == serial(prior, defs, changes)


def test_planner_of_nothing(spark):
    none = spark.createDataFrame([], CHANGES)
    assert planner.plan_symbols(sym(spark), sym(spark).withColumnRenamed("key", "ord"), none).count() == 0
    assert planner.retired(sym(spark), spark.createDataFrame([], "key string"), none).count() == 0


def test_entities_and_moves(spark, rows):
    before = sym(spark, ("k1", "p", "a.f", "f", "function", "x.py", "s", "b", "h"), ("k2", "p", "a.g", "g", "function", "x.py", "s", "b2", "h2"), ("k3", "p", "a.m", "m", "function", "x.py", None, "b3", "h3"), ("k4", "p", "a.l", "l", "function", "x.py", None, "b4", "h4"))
    after = sym(spark, ("k1", "p", "a.f", "f", "function", "x.py", "s2", "b", "h"), ("k9", "p", "a.g2", "g2", "function", "x.py", "s", "b2", "h2"), ("k3", "p", "a.m", "m", "function", "y.py", None, "b3", "h3"), ("k4", "p", "a.l", "l", "function", "x.py", None, "b5", "h4"))
    got = rows(review.changed_entities(before, after))
    assert got == sorted([("x.py", "k1", "a.f", "a.f", "contract_changed"), ("x.py", "k2", "a.g", "a.g2", "rename"), ("y.py", "k3", "a.m", "a.m", "rename"), ("x.py", "k4", "a.l", "a.l", "formatting_only")], key=str)
    assert review.changed_entities(sym(spark), sym(spark)).count() == 0
    nodes = spark.createDataFrame([("k1", "code_symbol", "a.f", False, "function"), ("c", "code_symbol", "a.caller", False, "function"), ("t", "code_symbol", "a.test", True, "test"), ("I", "invariant", "INV", False, None), ("R", "requirement", "REQ", False, None)], "stable_key string, kind string, identifier string, is_test boolean, symbol_kind string")
    claims = spark.createDataFrame([("k1", "I", "enforces", "active", 9000, 10000), ("k1", "R", "implements", "stale", 9000, 10000), ("c", "R", "implements", "active", 7000, 10000), ("c", "I", "implements", "active", 6000, 10000)], "src string, dst string, kind string, status string, confidence_bp int, evidence_bp int")
    entities = review.changed_entities(before, after)
    direct = review.direct_findings(entities, claims, nodes)
    assert rows(direct.select("source", "intent", "severity", "confidence_bp")) == [("k1", "I", "high", 9000)]
    calls = spark.createDataFrame([("c", "k1"), ("t", "k1")], "caller string, callee string")
    assert rows(review.indirect_findings(entities, claims, nodes, calls, direct).select("source", "intent", "confidence_bp", "via")) == [("c", "R", 7000, "a.f")]
    gate = review.blocked(direct, spark.createDataFrame([(False,)], "destructive boolean"))
    assert tuple(gate.first()) == (True, True, True, False)
    assert tuple(review.blocked(direct.limit(0), gate.select("destructive").limit(0)).first()) == (False, False, False, False)


ART = "kind string, id string, provider string, title string, body string"
LINK = "src_kind string, src string, link string, target_kind string, target string"


def queue(anchor, links, known, bound):
    rank = {"references": 1, "contains_commit": 2, "related_issue": 3, "comments_on": 4}
    around = {}
    for sk, s, link, tk, t in links:
        if tk == "code_symbol" or (sk, s) not in known or (tk, t) not in known:
            continue
        around.setdefault((sk, s), set()).add((rank[link], known[tk, t], tk, t, link))
        around.setdefault((tk, t), set()).add((rank[link], known[sk, s], sk, s, link))
    seen, todo, out = {("issue", anchor)}, deque([("issue", anchor)]), []
    while todo:
        for _, _, k, i, link in sorted(around.get(todo.popleft(), ())):
            if (k, i) in seen:
                continue
            seen.add((k, i))
            out.append((k, i, link))
            todo.append((k, i))
            if len(out) == bound:
                return out
    return out


def test_ticket_units_against_a_queue(spark):
    rng = random.Random(4)
    arts = [("issue", f"K-{n}", "jira") for n in range(12)] + [("comment", f"c{n}", "jira") for n in range(30)] + [("commit", f"h{n}", "git") for n in range(10)]
    ids = {k: [i for kk, i, _ in arts if kk == k] for k in ("issue", "comment", "commit")}
    links = [("comment", c, "comments_on", "issue", "K-0" if rng.random() < 0.5 else rng.choice(ids["issue"])) for c in ids["comment"]]
    links += [("issue", rng.choice(ids["issue"]), "related_issue", "issue", rng.choice(ids["issue"])) for _ in range(12)] + [("commit", rng.choice(ids["commit"]), "references", "issue", rng.choice(ids["issue"] + ["K-99"])) for _ in range(9)]
    links.append(("commit", "h1", "changed_symbol", "code_symbol", "K-1"))
    known = {(k, i): p for k, i, p in arts}
    a = spark.createDataFrame([(*x, "t", "") for x in arts], ART)
    l = spark.createDataFrame(links + links[:4], LINK)
    anchors_ = spark.createDataFrame([(f"K-{n}",) for n in range(12)] + [("K-0",)], "anchor string")
    for bound in (5, 40):
        got = {}
        for r in nb.ticket_units(anchors_, l, a, bound).collect():
            got.setdefault(r["anchor"], {})[r["place"]] = (r["kind"], r["id"], r["link"])
        for n in range(12):
            want = queue(f"K-{n}", [x for x in links if not (x[1] == x[4] and x[0] == x[3])], known, bound)
            assert [got.get(f"K-{n}", {}).get(i + 1) for i in range(len(want))] == want and len(got.get(f"K-{n}", {})) == len(want)


def test_rendered_text_stops_at_the_budget(spark):
    rows_ = [("issue", "A", n, x) for n, x in enumerate(["a" * 40, "b" * 40, "c" * 80, "d"])] + [("issue", "B", 0, "short"), ("issue", "B", 1, ""), ("issue", "C", 0, None)]
    got = {r["id"]: r for r in nb.rendered(spark.createDataFrame(rows_, "kind string, id string, place int, section string"), 30).collect()}
    assert got["A"]["text"] == "a" * 40 + "\n\n" + "b" * 40 + "\n\n" + "c" * 24 + "…" and got["A"]["truncated"] and got["A"]["tokens"] == 27
    assert (got["B"]["text"], got["B"]["truncated"]) == ("short", False)
    with pytest.raises(ValueError):
        nb.rendered(spark.createDataFrame(rows_, "kind string, id string, place int, section string"), 0)


def test_drift_classes(spark, rows):
    current = spark.createDataFrame([("a.new", "k1", "s1"), ("b.same", "k2", "s2"), ("c.two", "k3", "s3"), ("d.two", "k4", "s4")], "name string, key string, shape string")
    past = spark.createDataFrame([("a.old", "k0", "s1")], "name string, key string, shape string")
    links = spark.createDataFrame([("D", "a.old"), ("D", "x.same"), ("D", "x.two"), ("D", "x.none"), ("D", "a.new")], "document string, symbol string")
    found = repair.drift(links, current, past)
    assert rows(found) == [("D", "a.old", "R1", "a.new"), ("D", "x.none", "R4", None), ("D", "x.same", "R2", "b.same"), ("D", "x.two", "R3", None)]
    assert rows(repair.applied(links, found)) == sorted([("D", "a.new"), ("D", "b.same"), ("D", "x.two"), ("D", "x.none")])
    assert rows(repair.suggested(found, current).filter("symbol = 'x.two'")) == [("D", "x.two", 1, "c.two"), ("D", "x.two", 2, "d.two")]
    assert repair.drift(links.limit(0), current, past).count() == 0


def test_batches_and_numbers(spark, rows):
    sizes = [5, 5, 5, 20, 1, 1, 1, 1]
    df = spark.createDataFrame([("g", n, s) for n, s in enumerate(sizes)], "g string, n int, size int")
    assert [b for _, b in rows(repair.batches(df, "g", ["n"], F.col("size"), 3, 12).select("n", "batch"))] == [1, 1, 2, 3, 4, 4, 4, 5]
    ids = spark.createDataFrame([("A-1",), ("A-2",), ("A-4",), ("B-2",), ("C-1",), ("x",), (None,)], "k string")
    assert rows(repair.first_free(ids, "k")) == [("A", 3), ("B", 1), ("C", 2)]


def test_column_seeds_and_signatures(spark, rows):
    nodes = spark.createDataFrame([("db:t", "db_entity", "t", "t"), ("db:a.b", "db_entity", "a.b", "a.b"), ("s", "code_symbol", "x.y", "y")], "stable_key string, kind string, identifier string, name string")
    wanted = spark.createDataFrame([("t.id",), ("a.b",), ("a.b.c",), ("y.id",), ("nothing",)], "query string")
    assert rows(columns.column_seeds(nodes, wanted)) == [("a.b", "a.b", None), ("a.b.c", "a.b", "c"), ("nothing", "nothing", None), ("t.id", "t", "id"), ("y.id", "y.id", None)]
    df = spark.createDataFrame([("def f(a):", "f"), ("fn f<T>(a)", "f"), ("class f:", "f"), ("def fa(b)", "f"), (None, "f")], "s string, n string")
    assert [r[0] for r in df.select(columns.compact_signature(F.col("s"), F.col("n"))).collect()] == ["(a)", "<T>(a)", "", "def fa(b)", None]
    p = spark.createDataFrame([("/api/", "/x"), (None, "x"), ("/a", "")], "p string, r string").select(columns.joined_route(F.col("p"), F.col("r")))
    assert [r[0] for r in p.collect()] == ["/api/x", "/x", "/a"]
    q = spark.createDataFrame([("id", "/x/{id}", "GET", None), ("item", "/x", "POST", "Item"), ("q", "/x", "POST", "int")], "n string, p string, m string, t string")
    assert [r[0] for r in q.select(columns.parameter_place(*[F.col(c) for c in "npmt"])).collect()] == ["path", "body", "query"]


def test_answers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    calls = []

    def ask(prompts):
        calls.append(list(prompts))
        return ['x {"k": 1} y' if p == "a" or len(prompts) == 1 else None for p in prompts]

    got = agents.asked(df.coalesce(1), "prompt", lambda ps: ['x {"k": 1} y' if p == "a" or len(ps) == 1 else None for p in ps]).select(agents.json_within(F.col("answer"))).collect()
    assert [r[0] for r in got] == ['{"k": 1}'] * 2 and ask(["a"]) and calls


def test_trees(spark, rows):
    b = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")], "path string, content_hash string")
    a = spark.createDataFrame([("a", "9"), ("b2", "2"), ("e", "3")], "path string, content_hash string")
    assert rows(snapshots.tree_changes(b, a)) == sorted([("modified", "a", "a"), ("renamed", "b", "b2"), ("deleted", "c", None), ("deleted", "d", None), ("added", None, "e")], key=str)
    assert snapshots.tree_changes(b.limit(0), a.limit(0)).count() == 0
    nodes = spark.createDataFrame([("D", [("s", "f", 1), ("s", "f", 2), ("s", "f", 0)])], "stable_key string, anchors array<struct<symbol:string,fingerprint:string,ordinal:int>>")
    points = spark.createDataFrame([("s", "f", 3)], "symbol string, fingerprint string, line int")
    assert rows(anchors.confirmed(nodes, points)) == [("s", "f", 1)]
