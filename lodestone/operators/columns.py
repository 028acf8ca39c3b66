"""Seeds that name a column, evidence rows of a pack, and small expressions on code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower
from lodestone.model import SEMANTIC
from lodestone.operators.graph import resolve

# Relations in the order evidence is shown; words that give a condition weight; words of no meaning.
SHOWN = ("enforces", "implements", "covered_by", "satisfies", "depends_on")
WEIGHTY = ("attempt", "retry", "limit", "quota", "status", "state", "permission", "role", "expired", "timeout", "amount", "price", "paid")
EMPTY_WORDS = ("return", "else", "then", "true", "false", "error", "const", "none", "some", "self", "data")
TERMS = 18


def evidence_place(kind: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, SHOWN)), kind)
    return F.when(at > 0, at - 1).otherwise(len(SHOWN)).cast("int")


def evidence_rows(claims: DataFrame, selected: DataFrame) -> DataFrame:
    """(place, fingerprint, claim, claim_class, status, confidence_bp, sources, doubt, edge_id) between selected nodes.

    ``claims``: edge_id, src, dst, kind, claim_class, status, confidence_bp, fingerprint,
    stale_reason, sources (array). Structural claims need a source. Order by place and fingerprint.
    """
    end = lambda side: selected.select(F.col("stable_key").alias(side), F.col("identifier").alias(f"{side}_name"))
    j = claims.filter(F.col("kind").isin(*SEMANTIC) | (F.size("sources") > 0)).join(end("src"), "src").join(end("dst"), "dst")
    doubtful = (F.col("status") != "active") | (F.col("claim_class") == "inference")
    why = F.coalesce("stale_reason", F.when(F.col("status") == "active", "inferred relationship").otherwise("stale relationship"))
    return j.select(
        evidence_place(F.col("kind")).alias("place"), "fingerprint", F.concat_ws(" ", "src_name", "kind", "dst_name").alias("claim"), "claim_class", "status", "confidence_bp",
        F.array_join("sources", "; ").alias("sources"), F.when(doubtful, why).alias("doubt"), "edge_id",
    )


def column_seeds(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, seed, column): a query that is no name itself but ``table.column`` of exactly one table
    node stands for that table; any other stays as it is."""
    literal = resolve(nodes, wanted).select("query").distinct()
    parts = wanted.join(literal, "query", "left_anti").select(
        "query", F.regexp_extract("query", r"^(.*)\.([^.]*)$", 1).alias("table"), F.regexp_extract("query", r"^(.*)\.([^.]*)$", 2).alias("column")
    ).filter("table <> ''")
    found = resolve(nodes, parts.select(F.col("table").alias("query")).distinct()).join(nodes.select("stable_key", "kind"), "stable_key")
    tables = found.groupBy(F.col("query").alias("table")).agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")).filter("n = 1 and kind = 'db_entity'").select("table")
    seeds = parts.join(tables, "table", "left_semi")
    return wanted.join(seeds, "query", "left").select("query", F.coalesce("table", "query").alias("seed"), "column")


def locator_columns(locator: Column) -> Column:
    """The column names behind ``columns:`` of a locator."""
    rest = F.coalesce(F.get(F.split(locator, "columns:"), F.lit(1)), F.lit(""))
    return F.filter(F.transform(F.split(rest, ","), lambda c: F.trim(c)), lambda c: c != "")


def column_focus(asked: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(dst, column, readers, doubt): who reads, writes or declares a column of a table by its evidence.

    ``asked``: (dst, column); ``claims``: (src, dst, locators). Where no evidence names the column
    the doubt says so, and the impact of the whole table stands.
    """
    named = claims.select("src", "dst", F.explode(F.array_distinct(F.flatten(F.transform("locators", locator_columns)))).alias("column")).distinct()
    names = nodes.select(F.col("stable_key").alias("src"), "identifier")
    hit = named.join(asked, ["dst", "column"], "left_semi").join(names, "src", "left").groupBy("dst", "column").agg(F.array_join(F.array_sort(F.collect_set("identifier")), ",").alias("readers"))
    why = F.concat(F.lit("column '"), "column", F.lit("' is named by no evidence; the impact of the table is shown"))
    return asked.join(hit, ["dst", "column"], "left").select("dst", "column", F.coalesce("readers", F.lit("")).alias("readers"), F.when(F.col("readers").isNull(), why).alias("doubt"))


def compact_signature(signature: Column, name: Column) -> Column:
    """A signature without its keyword and name, where they come first."""
    s = F.trim(signature)
    out = s
    for word in ("def ", "fn ", "func ", "class "):
        head = F.concat(F.lit(word), name)
        tail = F.substring(s, F.length(head) + 1, F.length(s))
        fits = s.startswith(head) & ((tail == "") | F.left(tail, F.lit(1)).isin("(", ":", "<", "["))
        out = F.when(fits, F.regexp_replace(tail, r":$", "")).otherwise(out)
    return out


def condition_weight(condition: Column) -> Column:
    """4 for a condition that speaks of the business, else 0."""
    return F.when(F.lower(condition).rlike("|".join(WEIGHTY)), 4).otherwise(0)


def identifiers(code: Column) -> Column:
    """The first telling words of code, each once: camel case split, four bytes and more, no numbers."""
    split = F.split(F.regexp_replace(code, r"(?<=\p{Ll})(?=\p{Lu})", " "), r"[^\p{L}\p{N}]+")
    long = F.filter(split, lambda w: (F.octet_length(w) >= 4) & ~w.rlike(r"^[0-9]+$"))
    told = F.filter(F.transform(long, ascii_lower), lambda w: ~w.isin(*EMPTY_WORDS))
    return F.array_distinct(F.slice(told, 1, TERMS))


def joined_route(prefix: Column, route: Column) -> Column:
    """A router's prefix and a route as one path."""
    return F.concat(F.regexp_replace(F.coalesce(prefix, F.lit("")), r"/+$", ""), F.when(route.startswith("/"), route).when(route == "", "").otherwise(F.concat(F.lit("/"), route)))


def parameter_place(name: Column, path: Column, method: Column, typed: Column) -> Column:
    """Where a handler's parameter comes from: path, body of a writing method if it has a model type, query."""
    model = typed.isNotNull() & typed.rlike(r"^[A-Z]")
    return F.when(F.contains(path, F.concat(F.lit("{"), name, F.lit("}"))), "path").when(model & method.isin("POST", "PUT", "PATCH"), "body").otherwise("query")
