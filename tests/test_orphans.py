import random

from pyspark.sql import functions as F

from lodestone.operators import orphans as o

REFS = "ref_table string, ref_field string, row_id long, period string, key string, lo long, hi long, extra string"
RECS = "key string, start long, end long, extra string"


def brute(refs, recs):
    out = set()
    for t, f, i, p, k, lo, hi in refs:
        if k is None or (hi is not None and hi <= lo):
            continue
        own = [(s, e) for key, s, e in recs if key == k]
        stop = hi if hi is not None else 60
        if all(any(s <= c and (e is None or c < e) for s, e in own) for c in range(lo, stop)) and own:
            continue
        out.add((t, f, i, "missing" if not own else "late" if min(s for s, _ in own) > lo else "deleted", p))
    return out


def test_against_brute_force_with_hot_key(spark):
    rng = random.Random(1)
    refs, recs = [], []
    for i in range(1500):
        lo = rng.randrange(50)
        key = "hot" if rng.random() < 0.4 else rng.choice([None, *(f"k{n}" for n in range(40))])
        refs.append(("edges", "dst", i, "2024-01", key, lo, rng.choice([None, lo, lo + rng.randrange(1, 9)])))
    for n in range(30):
        for _ in range(rng.randrange(1, 4)):
            s = rng.randrange(40)
            recs.append((f"k{n}", s, rng.choice([None, s, s + 5, s + 20])))
    recs += [("hot", 0, 20), ("hot", 20, 30), ("hot", 25, 40), ("never used", 1, None)]
    r = spark.createDataFrame([(*x, "x") for x in refs + refs[:100]], REFS)
    e = spark.createDataFrame([(*x, "x") for x in recs + recs[:10]], RECS)
    want = brute(refs, recs)
    for floor, grain in ((100_000, 1), (50, 1), (50, 7)):  # plain, with the hot key dealt out, on a coarse axis
        got = [tuple(x) for x in o.orphan_references(r, e, floor, grain).select("ref_table", "ref_field", "row_id", "reason", "period").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_null(spark):
    r, e = spark.createDataFrame([], REFS), spark.createDataFrame([], RECS)
    assert o.orphan_references(r, e).count() == 0
    one = spark.createDataFrame([("t", "f", 1, None, "k", 3, None, "x"), ("t", "f", 2, None, None, 3, None, "x")], REFS)
    assert [tuple(x) for x in o.orphan_references(one, e).collect()] == [("t", "f", 1, "missing", None)]


def test_keys_and_routes(spark):
    df = spark.createDataFrame([(" a ", "https://h/x/{id}/y?q=1"), ("  ", "base_url"), (None, "https://host"), ("B\t", None)], "k string, u string")
    got = df.select(o.clean_key(F.col("k")), o.path_of_url(F.col("u")), o.route(F.lit("get"), F.coalesce(o.path_of_url(F.col("u")), F.lit("/")))).collect()
    assert [tuple(x) for x in got] == [("a", "/x/{id}/y", "GET /x/{param}/y"), (None, None, "GET /"), (None, "/", "GET /"), ("B", None, "GET /")]


def test_report_counts(spark, rows):
    found = spark.createDataFrame([("e", "src", 1, "late", "2024-01"), ("e", "src", 2, "late", "2024-01")], "ref_table string, ref_field string, row_id long, reason string, period string")
    assert rows(o.orphan_report(found)) == [("e", "src", "2024-01", "late", 2)]


def test_deltas_of_changes_equal_one_run_over_everything(spark, rows):
    from lodestone.session import scratch

    rng = random.Random(6)
    state, refs, recs = o.OrphanState(spark, scratch(spark, "orphans")), [], []
    cols = lambda df: df.select("key", "first", "bare")
    for n in range(10):  # past a compaction
        old_refs, old_recs = list(refs), list(recs)
        for _ in range(6):
            lo = rng.randrange(30)
            refs.append(("e", "dst", rng.randrange(10**6), "m", f"k{rng.randrange(8)}", lo, rng.choice([None, lo, lo + 4])))
            recs.append((f"k{rng.randrange(10)}", lo, rng.choice([None, lo, lo + 9])))
        for rows_ in (refs, recs):
            rng.shuffle(rows_)
            del rows_[: rng.randrange(4)]  # rows go, and others come twice
        refs.append(refs[0])
        frame = lambda x, schema: spark.createDataFrame([(*r, "x") for r in x], schema)
        changes = o.reference_deltas(o.row_changes(frame(old_refs, REFS), frame(refs, REFS))).unionByName(o.existence_deltas(o.row_changes(frame(old_recs, RECS), frame(recs, RECS))))
        got = state.apply(n, changes)
        if n in (0, 4, 9):
            whole = o.orphaned_keys(o.summed(o.reference_deltas(frame(refs, REFS)).unionByName(o.existence_deltas(frame(recs, RECS)))))
            assert rows(cols(got)) == rows(cols(whole)) and whole.count()
