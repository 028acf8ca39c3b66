"""Contracts with a model that reads and judges: what of its answers counts.

The model itself is a function of the caller's, given to :func:`asked`; nothing here calls one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts that count.
VERDICTS = ("confirm", "reject")


def json_within(answer: Column) -> Column:
    """The outermost braces of an answer, whatever stands around them; null without any."""
    found = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def asked(rows: DataFrame, column: str, ask: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """Rows with ``answer``: each batch's prompts go to ``ask``; what it leaves empty is asked once more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame[column].tolist()
            answers = list(ask(prompts))
            open_ = [k for k, a in enumerate(answers) if not a]
            for k, a in zip(open_, ask([prompts[k] for k in open_]) if open_ else []):
                answers[k] = a
            yield frame.assign(answer=answers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, answer string")


def validated(judgments: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case, class, document, diverges) of judgments whose citations are held against the evidence.

    ``judgments``: case, class, explanation, suspected; ``citations``: case, id, quote; ``evidence``:
    case, id, kind, excerpt, assertion. A quote has to stand in the excerpt it cites, else the
    judgment is unverified. Established needs an explanation and exactly one asserted document,
    anything cited; a divergence needs code and an assertion.
    """
    own = evidence.select("case", "id", "kind", "excerpt", "assertion").distinct()
    cited = citations.distinct().join(own, ["case", "id"], "left")
    fine = (F.trim("quote") != "") & F.coalesce(F.contains("excerpt", F.col("quote")), F.lit(False))
    seen = cited.groupBy("case").agg(
        F.min(fine).alias("sound"), F.count(F.lit(1)).alias("cited"), F.countDistinct("assertion").alias("asserted"), F.min("assertion").alias("assertion"), F.coalesce(F.max(F.col("kind") == "code"), F.lit(False)).alias("code")
    )
    j = judgments.join(seen, "case", "left").withColumn("asserted", F.coalesce("asserted", F.lit(0))).withColumn("cited", F.coalesce("cited", F.lit(0)))
    diverges = F.col("suspected") & F.coalesce("code", F.lit(False)) & (F.col("asserted") > 0)
    established = (F.col("class") == "established") & (F.trim("explanation") != "") & (F.col("asserted") == 1)
    kind = (
        F.when(~F.coalesce("sound", F.lit(True)), "unverified").when(diverges, "conflicting").when(F.col("cited") == 0, "unknown")
        .when(established, "established").when(F.col("class") == "established", "inferred").otherwise(F.col("class"))
    )
    return j.select("case", kind.alias("class"), F.when(kind == "established", F.col("assertion")).alias("document"), diverges.alias("diverges"))


def verdicts(claims: DataFrame, said: DataFrame) -> DataFrame:
    """(fingerprint, verdict, reason) that count: of known claims, well formed, with a reason, and of
    which no other contradicts it."""
    real = said.filter(F.col("verdict").isin(*VERDICTS) & (F.trim("reason") != "")).join(claims.select("fingerprint").distinct(), "fingerprint", "left_semi")
    one = real.groupBy("fingerprint").agg(F.countDistinct("verdict").alias("n"), F.min("verdict").alias("verdict"), F.min("reason").alias("reason"))
    return one.filter("n = 1").drop("n")


def grounded(proposals: DataFrame, allowed: DataFrame) -> DataFrame:
    """Proposals (kind, id, symbols) cut to the symbols of their neighborhood, and how many went."""
    own = allowed.groupBy("kind", "id").agg(F.collect_set("identifier").alias("_own"))
    j = proposals.join(own, ["kind", "id"], "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    kept = F.array_intersect("symbols", "_own")
    return j.select("kind", "id", kept.alias("symbols"), (F.size(F.array_distinct("symbols")) - F.size(kept)).cast("long").alias("dropped"))
