"""Text expressions: references, terms, templates, budgets. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words without weight in requirement texts.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "must", "shall", "should", "are")


def ascii_lower(text: Column) -> Column:
    """Lower case of the ASCII letters only."""
    return F.translate(text, UPPER, LOWER)


def _runs(text: Column, least: int) -> Column:
    """Distinct runs of letters and digits of an already lowered text."""
    return F.filter(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+")), lambda w: F.octet_length(w) >= least)


def words(text: Column, least: int = 3) -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least`` bytes."""
    return _runs(ascii_lower(text), least)


def terms(text: Column) -> Column:
    """Distinct terms: camel case split, plural s cut off, at least three bytes long."""
    split = F.regexp_replace(text, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " ")

    def stem(w: Column) -> Column:
        plural = w.endswith("s") & ~w.endswith("ss") & (F.octet_length(w) > 3)
        return F.when(w == "dedupe", "dedup").when(plural, F.left(w, F.length(w) - 1)).otherwise(w)

    return F.array_distinct(F.transform(_runs(ascii_lower(split), 3), stem))


def requirement_terms(text: Column) -> Column:
    return F.array_except(words(text, 3), F.array(*map(F.lit, STOP_WORDS)))


def references(text: Column) -> Column:
    """Array of (kind, value): ticket keys, issue and merge request numbers, urls; each once."""
    found = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    take = lambda pattern, g=1: F.regexp_extract_all(text, F.lit(pattern), g)
    ticket = take(r"(?<![\p{L}\p{N}])([A-Z]{2,10}-[0-9]{1,6})(?![0-9A-Za-z])")
    issue = take(r"(?<![\p{L}\p{N}])#([0-9]+)(?![0-9A-Za-z])")
    merge = take(r"(?<![\p{L}\p{N}])!([0-9]+)(?![0-9A-Za-z])")
    url = F.transform(take(r"(https?://[^\s)\]}>\"']+)"), lambda u: F.regexp_replace(u, r"[.,:;]+$", ""))
    return F.array_distinct(F.concat(found("ticket_key", ticket), found("issue_number", issue), found("merge_request_number", merge), found("url", url)))


def path_template(url: Column) -> Column:
    """Path shape of a url or path: no authority, query or fragment; ``{...}`` segments as ``{param}``.

    A host without path gives ``/``; a text that is neither url nor path gives null.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    shape = F.regexp_replace(bare, r"(?<=/)\{[^/]*\}(?=/|$)", "{param}")
    absolute = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    return F.when(absolute & (shape == ""), "/").when(shape.startswith("/"), shape)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    return F.when(F.length(text) > 4 * tokens, F.concat(F.left(text, 4 * tokens), F.lit("…"))).otherwise(text)


def derived_title(text: Column) -> Column:
    """The first sentence of the first line, at most 80 characters."""
    line = F.trim(F.split(F.trim(text), r"\n", 2)[0])
    first = F.regexp_extract(line, r"^(.*?[.!?])(?:\s|$)", 1)
    title = F.when(first != "", first).otherwise(line)
    return F.when(F.length(title) > 80, F.concat(F.left(title, F.lit(80)), F.lit("…"))).otherwise(title)


def log2_floor(n: Column) -> Column:
    """floor(log2(n)) of a positive integer, exact."""
    return F.length(F.bin(n)) - 1


def lexical_scores(docs: DataFrame, task: list[str], key: str, weighted: dict[str, int]) -> DataFrame:
    """(key, score): integer TF-IDF of each document for the task's terms.

    ``weighted``: column to weight, heaviest first; a term counts with the heaviest column that
    has it. idf = floor(log2(N + 1)) - floor(log2(df)) + 1, times 25. Only hits are shuffled.
    """
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    wanted = F.array(*map(F.lit, task))
    # a term is the beginning of its word, so only texts that contain one are cut into terms
    holds = lambda c: reduce(lambda a, b: a | b, [F.contains(F.col(f"_low_{c}"), F.lit(t)) for t in task])
    low = docs.select(key, *weighted, *[ascii_lower(F.col(c)).alias(f"_low_{c}") for c in weighted])  # once, for all terms
    cols = low.select(key, *[terms(F.when(holds(c), F.col(c)).otherwise("")).alias(f"_{c}") for c in weighted])
    hit = cols.select(key, *[f"_{c}" for c in weighted], F.explode(wanted).alias("term"))
    weight = F.lit(None).cast("int")
    for c, w in reversed(list(weighted.items())):
        weight = F.when(F.array_contains(f"_{c}", F.col("term")), w).otherwise(weight)
    hits = materialise(hit.select(key, "term", weight.alias("weight")).filter("weight is not null"), "hits")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(log2_floor(F.col("total") + 1) - log2_floor(F.col("df")), F.lit(0)) + 1
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(total))  # one row per task term; one row
    return scored.groupBy(key).agg(F.sum(F.col("weight") * idf * 25).cast("long").alias("score"))
