"""Evaluation texts leaking into training text.

The n-grams of the held-out items go out as a broadcast hash set. Every document is scanned by a
rolling hash over its word windows; each hit is verified against the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise, ship

N = 10
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    if "İ" in text:  # its lower case holds a mark that would part a word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


class GramSet:
    """The n-grams of some items: word ids, hashes of the windows, and items by exact window."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, self.ids = n, {}
        self.owners: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text or "")]
            for i in range(len(codes) - n + 1):
                own = self.owners.setdefault(tuple(codes[i : i + n]), [])
                if item not in own:
                    own.append(item)
        grams = np.array(list(self.owners), np.int64).reshape(-1, n)
        self.powers = np.power(BASE, np.arange(n, dtype=np.uint64))
        keys = self._spread((grams.astype(np.uint64) * self.powers).sum(1, dtype=np.uint64))
        self.bits = max(16, (16 * len(keys)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _spread(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text its verified hits: (index of the window's first word, item)."""
        get = self.ids.get
        codes, ends = [], []
        for t in texts:
            if t:
                codes.extend([get(w, 0) for w in words_of(t)])
            codes.append(0)
            ends.append(len(codes))
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        a = np.array(codes, np.int64)
        if not self.owners or len(a) < self.n:
            return found
        gaps = np.concatenate([[0], np.cumsum(a == 0)])
        at = np.flatnonzero(gaps[self.n :] == gaps[: -self.n])
        h = np.zeros(len(at), np.uint64)
        u = a.astype(np.uint64)
        for j in range(self.n):
            h += u[at + j] * self.powers[j]
        at = at[self.seen[self._slot(self._spread(h))]]
        starts = np.concatenate([[0], ends[:-1]]) if ends else np.empty(0, int)
        for i, doc in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
            for item in self.owners.get(tuple(codes[i : i + self.n]), ()):
                found[doc].append((i - int(starts[doc]), item))
        return found


def item_blocks(items: DataFrame, item_id: str, text: str, n: int = N) -> Iterator[GramSet]:
    """Gram sets of at most ``BLOCK_WORDS`` words each, one at a time.

    Held-out sets are tables of fixed size. A larger one is cut into blocks, each within the
    bound, and the corpus is held against them one after the other.
    """
    block: list[tuple[int, str]] = []
    room = BLOCK_WORDS
    for row in items.select(item_id, text).filter(F.col(text).isNotNull()).distinct().toLocalIterator():
        size = len(words_of(row[1]))
        if size > room and block:
            yield GramSet(block, n)
            block, room = [], BLOCK_WORDS
        block.append((row[0], row[1]))
        room -= size
    if block:
        yield GramSet(block, n)


def leaks(
    documents: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id) of every document that shares at least ``n`` consecutive words with an item.

    Null and empty texts and items of fewer than ``n`` words share nothing. One row per pair,
    whatever repeats; the scan needs no shuffle, only its few hits are made distinct. With several
    blocks of items the hits of each are written before the next is sent out.
    """
    spark = documents.sparkSession
    ship(spark)
    kinds = [documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    texts = documents.select(doc_id, text).filter(F.col(text) != "")
    out: list[DataFrame] = []
    shared = None
    for block in item_blocks(items, item_id, text, n):
        if shared is not None:
            out[-1] = materialise(out[-1], "leaks")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)  # BLOCK_WORDS words

        def scan(batches: Iterator[pa.RecordBatch], grams=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = grams.value.scan(batch.column(1).to_pylist())
                pairs = [(k, i) for k, found in enumerate(hits) for i in dict.fromkeys(i for _, i in found)]
                rows = pa.array([k for k, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([i for _, i in pairs], pa.int64() if kinds[1] == "bigint" else None)],
                    names=["doc_id", "item_id"],
                )

        out.append(texts.mapInArrow(scan, schema))
    if not out:
        return spark.createDataFrame([], schema)
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.distinct()


def cut_spans(text: str, firsts: list[int], n: int = N) -> str:
    """The text without the stretches that the windows beginning at these words cover."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, upto = [], 0
    for i in sorted(set(firsts)):
        start, end = spans[i][0], spans[i + n - 1][1]
        if start > upto:
            out.append(text[upto:start])
        upto = max(upto, end)
    return "".join(out) + text[upto:]


def without_leaks(
    documents: DataFrame, items: DataFrame, n: int = N, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Documents with leaked stretches cut out: (doc_id, text, cut), cut in code points.

    Documents without leaks pass unchanged with cut 0; a null text stays null. Blocks of items go
    over the corpus one after the other; only between blocks are texts written.
    """
    spark = documents.sparkSession
    ship(spark)
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, text string, firsts array<int>"
    none = F.array().cast("array<int>")
    marked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), none.alias("firsts"))
    shared = None
    for block in item_blocks(items, item_id, text, n):
        if shared is not None:
            marked = materialise(marked, "leaks-marked")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)  # BLOCK_WORDS words

        def mark(batches: Iterator[pa.RecordBatch], grams=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = grams.value.scan(batch.column(1).to_pylist())
                firsts = [old + [i for i, _ in found] for old, found in zip(batch.column(2).to_pylist(), hits)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.list_(pa.int32()))], names=["doc_id", "text", "firsts"])

        marked = marked.mapInArrow(mark, schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            new = [cut_spans(t, f, n) if f else t for t, f in zip(texts, batch.column(2).to_pylist())]
            cut = [len(t) - len(x) if t else 0 for t, x in zip(texts, new)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()), pa.array(cut, pa.int64())], names=["doc_id", "text", "cut"]
            )

    return marked.mapInArrow(clean, f"doc_id {kind}, text string, cut bigint")
