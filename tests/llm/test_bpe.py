import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

FILE = "/opt/tokenizers/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")
reference = tokenizers.Tokenizer.from_file(FILE)
reference.encode_special_tokens = True
vocabulary = bpe.Vocabulary(FILE)


def ours(texts):
    ids, at = bpe.Encoder(vocabulary).encode(texts)
    return [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))]


def theirs(texts):
    return [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts():
    texts = [
        "", " ", "  ", "a  b", "\n\n x", "a \n b", "   x  ", "x   ", "\x1c a \x1d", " a 　b", "<|endoftext|> hi", "it's 'll we'RE", "🙂👍🏽 x", " \t\tx", "​ ​x", " 1234 5 ½ ²", "\x85 y \x1f z", "﻿x",
        "a" * 5000, "ab" * 3000, "é" * 3000, "aaaa" * 600 + " b", "x" * 2047 + " " + "yz" * 1500, "word " * 3000,
    ]
    assert ours(texts) == theirs(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'sé1_-.\u00a0"), st.characters(blacklist_categories=("Cs",))), max_size=60), min_size=1, max_size=8))
def test_any_text(texts):
    assert ours(texts) == theirs(texts)


def test_cache_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    encoder = bpe.Encoder(vocabulary)
    for text in ("one two three four", "five six", "one two", "seven eight nine ten"):
        assert encoder.encode([text])[0].tolist() == theirs([text])[0]


def test_pair_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 3000, (5000, 2)), axis=0)
    table = bpe.PairTable(keys[:, 0], keys[:, 1])
    assert (table.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    other = np.array([[5000, 1], [0, 9000]])
    assert (table.find(other[:, 0], other[:, 1]) == bpe.NONE).all()


def test_column(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_column(df, FILE).filter("doc_id <> 3").collect())
    hello = theirs(["hello world"])[0]
    assert got == [(1, hello), (1, hello), (2, [])]
    assert bpe.encode_column(df, FILE).filter("doc_id = 3").first()["ids"] is None
    assert bpe.encode_column(df.filter("doc_id > 9"), FILE).count() == 0


def test_leftmost_alone_gives_the_same(monkeypatch):
    texts = ["aaaaaaa banana", "mississippi 1000000 ......", "ababab" * 50, "é" * 99, " \n\n\n x"]
    assert vocabulary.together
    monkeypatch.setattr(vocabulary, "together", False)
    assert ours(texts) == theirs(texts)


def test_words_beyond_any_usual_length():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefghij"), n)) for n in (2047, 2048, 2049, 30_000)] + ["-" * 50_000, "7" * 9_000]
    assert ours(texts) == theirs(texts)


def test_a_vocabulary_that_forbids_merging_together(tmp_path):
    import json

    # ab is made by the last merge, yet (ab, c) ranks first
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols())} | {"abc": 256, "ab": 257}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": ["ab c", "a b"]}}))
    own = bpe.Vocabulary(str(path))
    assert not own.together
    assert own.merge_words(["abcab"])[0].tolist() == [256, 257]


def test_a_changed_file_is_read_anew(spark, tmp_path):
    import json
    import shutil

    path = tmp_path / "v.json"
    shutil.copy(FILE, path)
    df = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    first = bpe.encode_column(df, str(path)).first()["ids"]
    model = json.loads(path.read_text())
    model["model"]["merges"] = []
    path.write_text(json.dumps(model))
    assert bpe.encode_column(df, str(path)).first()["ids"] != first and first == theirs(["hello"])[0]
