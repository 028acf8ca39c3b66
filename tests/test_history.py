import datetime as dt
import random

from lodestone.operators import history as h

SNAP = "commit_seq long, commit_oid string, is_complete boolean"
ROWS = "commit_seq long, fingerprint string, status string, recorded_at timestamp, confidence_bp int"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(rows, snaps):
    out = set()
    for fp in {r[1] for r in rows}:
        shown = {}
        for c, f, s, t in sorted((r for r in rows if r[1] == fp), key=lambda r: (r[3], r[2] or "")):
            shown[c] = s
        now, start, known = None, None, None
        for c, whole in snaps:
            if c in shown:
                s = shown[c].strip().lower() if shown[c] else known
                if s is None:
                    continue
                known = s
                if now != s:
                    if now is not None:
                        out.add((fp, now, start, c))
                    now, start = s, c
            elif whole and now is not None:
                out.add((fp, now, start, c))
                now = None
        if now is not None:
            out.add((fp, now, start, -1))
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    snaps = [(10 * i, rng.random() < 0.7) for i in range(1, 13)]
    rows, n = [], 0
    for k in range(60):
        for c, _ in snaps:
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
                n += 1
                rows.append((c, f"f{k}", rng.choice(["active", " Active", "STALE", "rejected ", None]), at(n)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows + rows[:50]], ROWS)
    snapshots = spark.createDataFrame([(c, "x", w) for c, w in snaps], SNAP)
    got = [tuple(r) for r in h.status_history(df, snapshots).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, snaps)


def test_ledger_supersedes_without_overwriting(spark, rows):
    df = spark.createDataFrame([(10, "f", "active", at(1), 1), (10, "f", "stale", at(5), 1), (10, "f", "stale", at(5), 1)], ROWS)
    snapshots = spark.createDataFrame([(10, "x", True), (20, "y", True)], SNAP)
    slots = h.slots_of(snapshots)
    ledger = h.bitemporal_ledger(h.assertions(df, slots)).select("status", "recorded_from", "recorded_to")
    assert rows(ledger) == [("active", at(1), at(5)), ("stale", at(5), None)]
    assert rows(h.status_history(df, snapshots, at(2))) == [("f", "active", 10, 20)]
    assert rows(h.status_history(df, snapshots)) == [("f", "stale", 10, 20)]


def test_late_interval_splits_earlier_ones(spark, rows):
    updates = spark.createDataFrame([("f", "active", 10, None, at(1)), ("f", "stale", 20, 40, at(2))], "fingerprint string, status string, valid_from long, valid_to long, recorded_at timestamp")
    snapshots = spark.createDataFrame([(c, "x", True) for c in (10, 20, 30, 40, 50)], SNAP)
    assert rows(h.status_history(updates, snapshots)) == [("f", "active", 10, 20), ("f", "active", 40, -1), ("f", "stale", 20, 40)]


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert h.status_history(none, spark.createDataFrame([], SNAP)).count() == 0
    assert h.status_history(none, spark.createDataFrame([(1, "x", True)], SNAP)).count() == 0
    only_null = spark.createDataFrame([(1, "f", None, at(1), 1), (1, None, "active", at(1), 1)], ROWS)
    assert h.status_history(only_null, spark.createDataFrame([(1, "x", True)], SNAP)).count() == 0


def sweep(rows):
    """Ledger by brute force: {(key, unit of valid time): [(status, recorded_from, recorded_to)]}."""
    out = {}
    for fp in {r[0] for r in rows}:
        for v in range(60):
            on = sorted({(t, s or "", s, lo, hi if hi is not None else 10**9) for f, s, lo, hi, t in rows if f == fp and lo <= v and (hi is None or v < hi)}, key=lambda x: (x[0], x[2] is not None, x[1], x[3], x[4]))
            for i, (t, _, s, lo, hi) in enumerate(on):
                out.setdefault((fp, v), []).append((s, t, on[i + 1][0] if i + 1 < len(on) else None))
    return out


def units(ledger):
    out = {}
    for r in ledger.collect():
        for v in range(r.valid_from, 60 if r.valid_to is None else r.valid_to):
            out.setdefault((r.fingerprint, v), []).append((r.status, r.recorded_from, r.recorded_to))
    return out


UPDATES = "fingerprint string, status string, valid_from long, valid_to long, recorded_at timestamp"


def test_off_snapshot_intervals_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for n in range(300):
        lo = rng.randrange(50)
        rows.append(("hot" if rng.random() < 0.4 else f"f{rng.randrange(6)}", rng.choice(["active", "stale", None]), lo, rng.choice([None, lo + rng.randrange(1, 12)]), at(n * 7)))
    rng.shuffle(rows)
    want = sweep(rows)
    frame = h.assertions(spark.createDataFrame(rows + rows[:20] + [("f0", "active", 5, 5, at(1))], UPDATES), None)
    for floor in (100_000, 40):  # plain, and with hot keys cut by day
        got = units(h.bitemporal_ledger(frame, True, floor))
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_ledger_rows_are_maximal_and_keep_what_was_replaced(spark, rows):
    updates = spark.createDataFrame([("f", "active", 0, 20, at(1)), ("f", "stale", 5, 9, at(2))], UPDATES)
    got = rows(h.bitemporal_ledger(h.assertions(updates, None)).drop("fingerprint"))
    assert got == sorted([("active", 0, 5, at(1), None, False), ("active", 5, 9, at(1), at(2), True), ("active", 9, 20, at(1), None, False), ("stale", 5, 9, at(2), None, False)], key=str)
    assert rows(h.status_history(updates, None)) == [("f", "active", 0, 5), ("f", "active", 9, 20), ("f", "stale", 5, 9)]
    assert rows(h.status_history(updates, None, at(1))) == [("f", "active", 0, 20)]


def test_hot_claim_of_snapshots(spark):
    rng = random.Random(4)
    snaps = [(10 * i, rng.random() < 0.7) for i in range(1, 13)]
    rows = [(rng.choice(snaps)[0], "hot" if rng.random() < 0.6 else f"f{rng.randrange(9)}", rng.choice(["active", "stale", None]), at(n * 5)) for n in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROWS)
    snapshots = spark.createDataFrame([(c, "x", w) for c, w in snaps], SNAP)
    got = [tuple(r) for r in h.status_history(df, snapshots, hot_floor=50).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, snaps)


def test_store_equals_one_ledger_over_all_deliveries(spark, rows):
    from lodestone.session import scratch

    rng, deliveries = random.Random(5), []
    for d in range(3):
        some = []
        for n in range(25):
            lo = rng.randrange(40)
            some.append((f"f{rng.randrange(4)}", rng.choice(["active", "stale"]), lo, rng.choice([None, lo + 5]), at(rng.randrange(900))))
        deliveries.append(some)
    store = h.LedgerStore(spark, scratch(spark, "ledger"))
    assert rows(store.read()) == []
    for some in deliveries:
        store.deliver(h.assertions(spark.createDataFrame(some, UPDATES), None))
    every = h.assertions(spark.createDataFrame(sum(deliveries, []), UPDATES), None)
    assert rows(store.read().select(*h.LEDGER)) == rows(h.bitemporal_ledger(every))
