import random

import numpy as np

from lodestone.llm import reading as r

EASY = [[f"{'abcdefgh'[i]}{'klmnopqr'[j]}{'xyz'[lv]}lev{'ivxw'[lv]}" for i in range(8) for j in range(8)] if lv < 3 else [f"{'abcdefgh'[i]}{'klmnopqr'[j]}wlevw" for i in range(8) for j in range(8)] for lv in range(4)]
COMMON = ["the", "and", "of", "to"]


def text(rng, level, sentences=14):
    out = []
    for _ in range(sentences):
        lv = level if rng.random() < 0.8 else rng.randrange(4)
        words = [rng.choice(EASY[lv]) if rng.random() < 0.6 else rng.choice(COMMON) for _ in range(8)]
        out.append(" ".join(words).capitalize() + ".")
    return "A short title\n\n" + " ".join(out) + "\n\n```\n" + " ".join(EASY[3]) + ".\n```\n"


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    docs = [(n, text(rng, n % 4), "x") for n in range(400)]
    docs += [(900, None, "x"), (901, "", "x"), (902, "Too short to be rated.", "x")]
    labels = []
    for n in range(0, 400, 4):
        for k in range(4):
            if n % 16 == 0:
                labels.append((n + k, 1 + (n + k) % 4 if rng.random() < 0.92 else rng.randrange(1, 5), "r1"))
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, reading_level string")
    l = spark.createDataFrame(labels + labels[:9] + [(1, None, "r2"), (2, 9, "r2")], "doc_id long, reading_level int, rater string")
    got = [tuple(x) for x in r.reading_levels(d, l).collect()]
    assert len(got) == len({k for k, _ in got}) == 400
    rated = {k for k, _, _ in labels}
    assert np.mean([v == 1 + k % 4 for k, v in got if k not in rated]) > 0.95


def test_without_labels_there_is_no_scale(spark):
    d = spark.createDataFrame([(1, text(random.Random(1), 1))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, reading_level int, rater string")
    assert r.reading_levels(d, none).count() == 0
    assert r.reading_levels(d.filter("doc_id > 1"), none).count() == 0


def test_prose():
    t = "[K-1] A title without end\n\n# Heading.\nFirst sentence here. Second, see https://x.y/z.\r\n- an item without end\n```\ncode line.\n```\n~~~\nunclosed."
    assert r.prose(t).split() == "first sentence here. second, see an item without end".split()
    codes = r.code_text("One two. Three 4 a_b!\n\nx", r.Coder())
    assert (codes == r.END).sum() == 2 and len(codes) == 5


def test_prose_lines_need_no_length():
    assert r.prose("fix(x): a title without any end " * 20) == ""
    assert r.prose("It ends here. And a cut sentence").split() == "it ends here. and a cut sentence".split()
    assert r.prose("It ends **here.**") != "" and r.prose("« It ends. »") != ""


def test_likelihood_never_falls(spark):
    rng = random.Random(8)
    d = spark.createDataFrame([(n, text(rng, n % 4)) for n in range(120)], "doc_id long, text string")
    l = spark.createDataFrame([(n, 1 + n % 4, "r1") for n in range(0, 120)], "doc_id long, reading_level int, rater string")
    codes = r.coded(d)
    known = codes.join(r.votes(l), "doc_id").cache()
    cells = r.cells_for(codes)
    model = r.Difficulties.of_counts(r.level_counts(known, cells, None, True))
    prior, seen = model.difficulty, []
    for _ in range(6):
        model, likelihood = r.item_step(known, model, prior)
        seen.append(likelihood)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
