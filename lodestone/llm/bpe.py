"""Encoding a corpus with a public byte-level BPE vocabulary.

Merging runs over padded numpy matrices, one word a row, in buckets of similar length. Each round
every row merges its leftmost pair of minimum rank, and with it the further occurrences of that
pair, which would be merged next in any case: no pair with a merged symbol ranks before the merge
that made it (checked when the vocabulary is read; where it does not hold, a round merges the
leftmost alone). Ranks are looked up in an open-addressing hash table and the matrix is compacted
to the left. Words of every length take this one path. Only words not met before reach the
matrices: a worker keeps the ids of the words it has seen.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.session import ship

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
GLUE = re.compile(r" (?=\s|\Z)")
CELLS = 1 << 21
CACHE = 400_000
CACHE_IDS = 8_000_000
ROWS = 2000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class PairTable:
    """Open addressing with linear probing: (left id, right id) to merge rank."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = self._key(left, right)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == self.EMPTY
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]] = keys[todo[put]]
            self.ranks[slot[put]] = todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no merge."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (held != self.EMPTY)
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out


class Vocabulary:
    """Byte ids, merge table and merged ids. Its size is that of the vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        model = json.loads(raw)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = np.array([ids[s] for s in byte_symbols()], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.table = PairTable(np.array([ids[a] for a, _ in pairs]), np.array([ids[b] for _, b in pairs]))

        made = {a + b: n for n, (a, b) in enumerate(pairs)}  # the last merge that makes a symbol
        self.together = all(max(made.get(a, -1), made.get(b, -1)) < n for n, (a, b) in enumerate(pairs))

    def _ranks(self, m: np.ndarray) -> np.ndarray:
        left, right = m[:, :-1], m[:, 1:]
        out = np.full(left.shape, NONE, np.int32)
        real = right >= 0
        out[real] = self.table.find(left[real], right[real])
        return out

    def _chosen(self, ranks: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Where a round merges: the leftmost pair of minimum rank of each row and, unless the
        vocabulary forbids it, those of its other occurrences that do not overlap, left to right."""
        hit = ranks == best[:, None]
        step = np.arange(hit.shape[1])
        if not self.together:
            return step == hit.argmax(1)[:, None]
        start = np.maximum.accumulate(np.where(hit, 0, step + 1), 1)  # where the run of hits begins
        return hit & ((step - start) % 2 == 0)

    def _merge_matrix(self, m: np.ndarray, owner: np.ndarray, out: list) -> None:
        """Merge rows until none has a pair left; finished rows leave the matrix."""
        ranks = np.full(m.shape, NONE, np.int32)
        ranks[:, :-1] = self._ranks(m)
        while len(m):
            best = ranks.min(1)
            done = best == NONE
            if done.any():
                for row, k in zip(m[done], owner[done]):
                    out[k] = row[row >= 0]
                go = ~done
                m, ranks, owner, best = m[go], ranks[go], owner[go], best[go]
                if not len(m):
                    return
            put = np.zeros(m.shape, bool)
            put[:, :-1] = self._chosen(ranks[:, :-1], best)
            rows, pos = np.nonzero(put)
            m[rows, pos] = self.merged[best[rows]]
            kept = m >= 0
            kept[rows, pos + 1] = False
            sizes = kept.sum(1)
            width = int(sizes.max())
            place = np.arange(width) < sizes[:, None]
            fresh = np.zeros((len(m), width + 1), bool)
            fresh[:, :-1][place] = put[kept]
            new = np.full((len(m), width), -1, np.int32)
            new[place] = m[kept]
            old = np.full((len(m), width), NONE, np.int32)
            old[place] = ranks[kept]
            m, ranks = new, old
            r, c = np.nonzero(fresh[:, :-1] | fresh[:, 1:])  # a new symbol, or one right of it
            right = np.full(len(r), -1, np.int32)
            inner = c + 1 < width
            right[inner] = m[r[inner], c[inner] + 1]
            rank = np.full(len(r), NONE, np.int32)
            real = right >= 0
            rank[real] = self.table.find(m[r[real], c[real]], right[real])
            ranks[r, c] = rank

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; words are those that the pattern yields."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            low = sizes[order[start]]
            if low < 2:
                end = int(np.searchsorted(sizes[order], 2))
                for k in order[start:end]:
                    out[k] = self.bytes[np.frombuffer(raw[k], np.uint8)]
                start = end
                continue
            width = int(low + low // 4)
            end = min(int(np.searchsorted(sizes[order], width, "right")), start + max(1, CELLS // width))
            chosen = order[start:end]
            width = int(sizes[chosen[-1]])
            flat = self.bytes[np.frombuffer(b"".join(raw[k] for k in chosen), np.uint8)]
            m = np.full((len(chosen), width), -1, np.int32)
            m[np.arange(width) < sizes[chosen][:, None]] = flat
            self._merge_matrix(m, chosen, out)
            start = end
        return out


class _Numbered(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes texts; remembers the ids of pieces between spaces within fixed bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pattern = vocabulary, regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.pieces = _Numbered()
        self.words: dict[str, np.ndarray] = {}
        self.flat = np.empty(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def split(self, text: str) -> list[int]:
        """Numbers of the pieces of the text, cut before a space that a word follows.

        The pattern always cuts there, so pieces can be encoded one by one. A piece is kept without
        its leading space; one that has none, or holds further blanks, is kept in a tuple.
        """
        head, *rest = text.split(" ")
        if not GLUE.search(text):
            return [self.pieces[(head,)], *map(self.pieces.__getitem__, rest)]
        out = [head]
        for p in rest:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return [self.pieces[(p,)] for p in out]

    def _learn(self, known: int) -> None:
        """Ids of the pieces numbered since ``known``."""
        fresh = list(self.pieces)[known:] if known else list(self.pieces)
        cut = [self.pattern.findall(p[0] if isinstance(p, tuple) else " " + p) for p in fresh]
        new = list({w for ws in cut for w in ws if w not in self.words})
        self.words.update(zip(new, self.v.merge_words(new)))
        parts = [self.words[w] for ws in cut for w in ws]
        sizes = np.fromiter((sum(len(self.words[w]) for w in ws) for ws in cut), np.int64, len(cut))
        self.flat = np.concatenate([self.flat, *parts]).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the offsets of each text in them; a null text has none."""
        if len(self.pieces) > CACHE or len(self.flat) > CACHE_IDS:
            self._forget()
        known = len(self.pieces)
        numbers = [self.split(t) if t else [] for t in texts]
        if len(self.pieces) > known:
            self._learn(known)
        which = np.fromiter(chain.from_iterable(numbers), np.int64)
        sizes = np.diff(self.offsets)[which] if len(which) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.offsets[which] - (ends - sizes), sizes) + np.arange(total)
        upto = np.concatenate([[0], np.cumsum([len(ns) for ns in numbers])]).astype(np.int64)
        return self.flat[source], np.concatenate([[0], ends])[upto]


_ENCODERS: dict[str, Encoder] = {}


def encode_column(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row: an empty text gives an empty list, a null text null.

    Whole texts, no special tokens; strings that look like special tokens are ordinary text. Rows
    that repeat come out as often as they are. Narrow: no shuffle. The vocabulary is read on the
    driver and broadcast; its size is fixed by the file.
    """
    spark = documents.sparkSession
    ship(spark)
    vocabulary = Vocabulary(vocabulary_path)
    shared, digest = spark.sparkContext.broadcast(vocabulary), vocabulary.digest
    kind = documents.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[digest] = Encoder(shared.value)
        encoder = _ENCODERS[digest]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids, offsets = encoder.encode(texts)
                starts = pa.array(offsets.astype(np.int32), mask=np.array([*(t is None for t in texts), False]))
                lists = pa.ListArray.from_arrays(starts, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(encode, f"`{key}` {kind.simpleString()}, ids array<int>")
