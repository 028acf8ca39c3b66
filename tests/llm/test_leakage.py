import random

from lodestone.llm import leakage

WORDS = [f"w{n}" for n in range(12)]


def brute(docs, items, n=10):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leakage.words_of(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs if t for i, s in items if s and grams(t) & grams(s)}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    items = [(n, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 10, 30])))) for n in range(20)] + [(90, None), (91, "")]
    docs = []
    for n in range(150):
        words = [rng.choice(WORDS) for _ in range(40)]
        if n % 3 == 0:
            source = rng.choice([s for _, s in items if s]).split()
            k = rng.choice([9, 10, 15])
            words[7:7] = source[:k]
        docs.append((n, rng.choice([" ", ", ", "\n"]).join(words).upper() if n % 2 else " - ".join(words)))
    docs += [(900, None), (901, ""), (902, "short")]
    d = spark.createDataFrame([(*r, "x") for r in docs + docs[:20]], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items + items[:3]], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    for bound in (2_000_000, 60):  # one block, and many
        monkeypatch.setattr(leakage, "BLOCK_WORDS", bound)
        got = [tuple(r) for r in leakage.leaks(d, i).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        cleaned = {r["doc_id"]: r for r in leakage.without_leaks(d, i).collect()}
        assert {k: r["text"] for k, r in cleaned.items()} == (first := locals().get("first") or {k: r["text"] for k, r in cleaned.items()})
    assert {k for k, r in cleaned.items() if r["cut"]} == {a for a, _ in want}
    assert cleaned[900]["text"] is None and cleaned[901]["text"] == ""
    assert all(len(r["text"]) + r["cut"] == len(dict(docs)[k]) for k, r in cleaned.items() if r["text"] is not None)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(d, none).count() == 0 and leakage.leaks(d.filter("doc_id > 1"), none).count() == 0


def test_words():
    assert leakage.words_of("Don't_stop—ÄPFEL42 İx") == ["don", "t", "stop", "äpfel42", "i̇x"]
