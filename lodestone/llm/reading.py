"""Reading level of each document.

A Rasch-style latent model on the raters' scale: every word has a difficulty and a discrimination,
every stretch of prose (a sentence or list item) a latent location, the mean of the difficulties of
its words weighted by their discriminations. Levels answer to locations by the rating-scale link:
the log-odds of two neighbouring levels are ``SLOPE`` times the distance of the location from the
threshold between them. Estimation alternates over all partitions: person step, the locations and
the level each stretch of a rated document shows; item step, a Newton step of the difficulties
towards the greatest likelihood of the ratings. It stops when the likelihood gains no more. One
row per word cell comes back; the number of cells follows the vocabulary, between fixed bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise, ship, together

LEVELS = 4
SCALE = np.arange(1, LEVELS + 1)
SLOPE = 8.0
OWN, OTHER = 0.7, 0.1
RIDGE = 1.0
PULL = 0.1  # weight of the middle level in the counts of a word
GAIN, MOST_ROUNDS = 1e-3, 30
LEAST_CELLS, MOST_CELLS = 1 << 14, 1 << 20
MIN_WORDS = 60
MEMO = 500_000
FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
NO_PROSE = re.compile(r"https?://\S+|`[^`\n]*`|\([^()\s]*_[^()\s]*\)")
ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s+")
ENDED = re.compile(r"[.!?:;…][\"'”»)*_|]*$|[。\"')]$")
WITHIN = re.compile(r"[.!?…][\"'”»)*_]*\s+\S")
TOKEN = re.compile(r"\w+|[.!?…](?=\s)|\n")
END, SKIP = -1, -2


class Coder(dict):
    """Word to its hash; marks that end a stretch to END, numbers and identifiers to SKIP."""

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            code = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
        else:
            code = SKIP if word[0].isalnum() or word[0] == "_" else END
        if len(self) < MEMO:
            self[word] = code
        return code


def prose(text: str) -> str:
    """The prose of a text, one paragraph line or list item a line: no titles, no code, no links.

    A line is prose if it ends a sentence, or holds the end of one; else it is a title.
    """
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    kept = []
    for line in text.split("\n"):
        line = line.strip()
        if not line or line[0] == "#":
            continue
        item = ITEM.match(line)
        if item:
            kept.append(line[item.end() :])
        elif ENDED.search(line) or WITHIN.search(line):
            kept.append(line)
    text = "\n".join(kept)
    if "http" in text or "`" in text or "_" in text:
        text = NO_PROSE.sub(" ", text)
    return text.lower()


def code_text(text: str | None, coder: Coder) -> np.ndarray:
    """Hashes of the words with END after every stretch."""
    if not text:
        return np.empty(0, np.int32)
    codes = np.fromiter(map(coder.__getitem__, TOKEN.findall(prose(text))), np.int32)
    codes = codes[codes != SKIP]
    if not len(codes):
        return codes
    codes = np.append(codes, np.int32(END))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != END) | (codes[:-1] != END)
    keep[0] = codes[0] != END
    return codes[keep]


def answers(at: np.ndarray) -> np.ndarray:
    """Probability of each level at a location: the rating-scale link."""
    log = SLOPE * (at[:, None] * SCALE - SCALE**2 / 2)
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def difficulties(mean: np.ndarray) -> np.ndarray:
    """The location that makes each mean level the most likely: Newton on the link."""
    b = mean.copy()
    for _ in range(20):
        p = answers(b)
        mu = p @ SCALE
        b = np.clip(b + (mean - mu) / (SLOPE * (p @ SCALE**2 - mu**2) + 1e-6), 0, LEVELS + 1)
    return b


class Difficulties:
    """Difficulty and discrimination of each cell; a discrimination of 0: no word was met."""

    def __init__(self, difficulty: np.ndarray, weight: np.ndarray):
        self.difficulty, self.weight = difficulty, weight
        self.mask = len(weight) - 1

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Difficulties:
        """From how often words stood in stretches of each level, every level counting alike."""
        total = counts.sum(0)
        even = counts * (total.sum() / LEVELS / np.where(total > 0, total, 1))
        n = even.sum(1)
        middle = SCALE.mean()
        mean = (even @ SCALE + PULL * middle) / (n + PULL)
        spread = np.maximum((even @ SCALE**2 + PULL * (SCALE**2).mean()) / (n + PULL) - mean**2, 0)
        met = n > 0
        difficulty = np.zeros(len(n))
        difficulty[met] = difficulties(mean[met])
        return cls(difficulty, np.where(met, 1 / (spread + 0.15 + 1 / (1 + n)), 0))

    def locate(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Location of each stretch and the sum of its discriminations, 0 where no word is known."""
        cells = words & self.mask
        weight = self.weight[cells]
        total = np.add.reduceat(weight, starts)
        return np.add.reduceat(weight * self.difficulty[cells], starts) / np.where(total > 0, total, 1), total

    def shown(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Level probabilities of each stretch; zeros where no word is known."""
        at, total = self.locate(words, starts)
        p = answers(at)
        p[total <= 0] = 0
        return p


def _stretches(codes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, starts of the stretches in them, the row of each stretch, words per row."""
    offsets = codes.offsets.to_numpy()
    flat = codes.values.to_numpy()[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = flat == END
    at = np.flatnonzero(ends)
    owner = np.searchsorted(offsets, at, "right") - 1
    before = np.cumsum(ends)
    words = flat[~ends]
    stops = at + 1 - before[at]
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    count = np.concatenate([[0], np.cumsum(~ends)])
    return words, starts.astype(np.int64), owner, count[offsets[1:]] - count[offsets[:-1]]


def coded(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, codes) of every document, narrow."""
    ship(documents.sparkSession)
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            rows = [code_text(t, coder) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "codes"])

    return documents.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, codes array<int>")


def votes(labels: DataFrame, doc_id: str = "doc_id", level: str = "reading_level") -> DataFrame:
    """(doc_id, v1..v4): how often raters gave each level; repeated rows count once."""
    real = labels.filter(F.col(level).between(1, LEVELS)).distinct()
    return real.groupBy(F.col(doc_id).alias("doc_id")).agg(
        *[F.count_if(F.col(level) == k).alias(f"v{k}") for k in range(1, LEVELS + 1)]
    )


NAMES = [f"v{k}" for k in range(1, LEVELS + 1)]


def _lean(batch: pa.RecordBatch, owner: np.ndarray) -> np.ndarray:
    """How likely the ratings of its document are at each level of a stretch."""
    v = np.stack([batch.column(n).fill_null(0).to_numpy().astype(float) for n in NAMES], 1)
    return (OTHER + (OWN - OTHER) * v / np.maximum(v.sum(1, keepdims=True), 1))[owner]


def _over_cells(rows: DataFrame, names: list[str], cells: int, run) -> np.ndarray:
    """Sums of ``run``'s rows (cell, names...) over all partitions, as a matrix with one row a cell
    and one more at the end for what belongs to no cell. At most ``MOST_CELLS`` + 1 rows are drawn."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((cells + 1, len(names)))
        for batch in batches:
            words, starts, owner, _ = _stretches(batch.column("codes"))
            if len(words):
                run(batch, words, starts, owner, sums)
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(sums[used, k]) for k in range(len(names)))], names=["cell", *names])

    sums = rows.mapInArrow(part, "cell int, " + ", ".join(f"{n} double" for n in names)).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((cells + 1, len(names)))
    out[sums.column("cell").to_numpy()] = np.stack([sums.column(n).to_numpy() for n in names], 1)
    return out


def level_counts(rows: DataFrame, cells: int, model: Difficulties | None, rated: bool) -> np.ndarray:
    """How often each cell's words stand in stretches of each level.

    The levels are those of the ratings, those of the model, or both, each as far as it is given.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch, words, starts, owner, sums):
        p = shared.value.shown(words, starts) if shared.value else np.ones((len(starts), LEVELS))
        if rated:
            p = p * (_lean(batch, owner) if shared.value else np.stack([batch.column(n).fill_null(0).to_numpy() for n in NAMES], 1)[owner])
        total = p.sum(1, keepdims=True)
        p = p / np.where(total > 0, total, 1)
        each = np.diff(np.append(starts, len(words)))
        for k in range(LEVELS):
            sums[:-1, k] += np.bincount(words & (cells - 1), np.repeat(p[:, k], each), cells)

    return _over_cells(rows.select("codes", *(NAMES if rated else [])), NAMES, cells, run)[:-1]


def item_step(rows: DataFrame, model: Difficulties, prior: np.ndarray) -> tuple[Difficulties, float]:
    """One alternation over the rated documents: the new difficulties, and the likelihood of the old.

    The likelihood of a stretch is that of its document's ratings, over the levels it may show. A
    location is a weighted mean of difficulties, so the log-likelihood is bounded below by a sum of
    terms of one word each (its share of the weight); a Newton step climbs each of them, held near
    ``prior`` by ``RIDGE``.
    """
    cells = len(model.weight)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch, words, starts, owner, sums):
        own = shared.value
        at, total = own.locate(words, starts)
        p = answers(at)
        joint = p * _lean(batch, owner)
        like = joint.sum(1)
        mean = p @ SCALE
        up = SLOPE * ((joint / like[:, None]) @ SCALE - mean)
        bend = SLOPE**2 * (p @ SCALE**2 - mean**2)
        known = total > 0
        each = np.diff(np.append(starts, len(words)))
        share = own.weight[words & own.mask] / np.repeat(np.where(known, total, 1), each)
        for k, x in enumerate((up, bend)):
            sums[:-1, k] += np.bincount(words & own.mask, share * np.repeat(x, each), cells)
        sums[-1, 0] += np.log(like[known]).sum()
        sums[-1, 1] += known.sum()

    sums = _over_cells(rows.select("codes", *NAMES), ["up", "bend"], cells, run)
    met = model.weight > 0
    off = np.where(met, model.difficulty - prior, 0)
    likelihood = (sums[-1, 0] - RIDGE / 2 * (off**2).sum()) / max(1.0, sums[-1, 1])
    step = np.clip((sums[:-1, 0] - RIDGE * off) / (sums[:-1, 1] + RIDGE), -0.5, 0.5)
    return Difficulties(np.where(met, model.difficulty + step, 0), model.weight), likelihood


def cells_for(codes: DataFrame) -> int:
    """Cells for a vocabulary: four a word, a power of two, within bounds."""
    words = codes.select(F.explode("codes").alias("w")).agg(F.approx_count_distinct("w")).first()[0]
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * max(1, words) - 1).bit_length()))


def fit(codes: DataFrame, labels: DataFrame, cells: int | None = None) -> Difficulties:
    """Alternate over all rated documents until the likelihood gains less than ``GAIN`` a stretch.

    Then one pass over the whole corpus gives words that no rated document holds the difficulty of
    the stretches they stand in. No row is sampled.
    """
    known, counted = together(lambda: materialise(codes.join(votes(labels), "doc_id"), "p9-rated"), lambda: cells or cells_for(codes))
    cells = counted
    model = Difficulties.of_counts(level_counts(known, cells, None, True))
    best = Difficulties.of_counts(level_counts(known, cells, model, True))
    prior, model, reached = best.difficulty, best, -np.inf
    for _ in range(MOST_ROUNDS):
        new, likelihood = item_step(known, model, prior)
        if likelihood > reached:
            best = model
        if likelihood < reached + GAIN:
            break
        model, reached = new, likelihood
    rest = Difficulties.of_counts(level_counts(codes, cells, best, False))
    met = best.weight > 0
    return Difficulties(np.where(met, best.difficulty, rest.difficulty).astype(np.float32), np.where(met, best.weight, rest.weight).astype(np.float32))


def levels(codes: DataFrame, model: Difficulties, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, reading_level): the level most stretches of the prose have; the easier on a tie."""
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = codes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts, owner, n = _stretches(batch.column("codes"))
            sums = np.zeros((batch.num_rows, LEVELS))
            if len(words):
                p = shared.value.shown(words, starts)
                for k in range(LEVELS):
                    sums[:, k] = np.bincount(owner, p[:, k], batch.num_rows)
            rows = np.flatnonzero((n >= min_words) & (sums.sum(1) > 0))
            best = (np.round(sums[rows], 6).argmax(1) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(best)], names=["doc_id", "reading_level"]
            )

    return codes.select("doc_id", "codes").mapInArrow(run, f"doc_id {kind}, reading_level int")


def reading_levels(documents: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Reading level of each document with enough prose, on the raters' scale.

    Null, empty and short texts have no row; without any label there is no scale and no row.
    Whole texts; repeated documents come out once.
    """
    codes = materialise(coded(documents), "p9-codes")
    return levels(codes, fit(codes, labels), min_words).dropDuplicates(["doc_id"])
