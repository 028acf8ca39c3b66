"""Queries of the text problems, with SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, code_docs, leakage, markup, pii, reading
from lodestone.session import read

TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_docs.pairs(read(spark, sf_dir, "source_files")).select("file_id", "start_line", "symbol_name")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_docs.pairs(read(spark, sf_dir, "source_files")).drop("top_line", "position")


def p3_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_docs.with_hints(code_docs.pairs(read(spark, sf_dir, "source_files")), read(spark, sf_dir, "code_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_information(read(spark, sf_dir, "jira_comments"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(read(spark, sf_dir, "jira_comments"))


def _tracker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = read(spark, sf_dir, "jira_comments").select(F.lit("jira_comments").alias("src_table"), F.col("fetch_id").alias("row_id"), F.col("body").alias("text"))
    issues = read(spark, sf_dir, "jira_issues").select(F.lit("jira_issues"), "issue_id", "description")
    return comments.union(issues)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_found(_tracker_texts(spark, sf_dir))


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(_tracker_texts(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_labels"))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_hints": p3_hints, "p4_found": p4_found, "p4_redacted": p4_redacted, "p6_found": p6_found, "p6_cleaned": p6_cleaned, "p7_ids": p7_ids, "p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_found": p9_found}

_P8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k+9], ' '))) AS g FROM d),
     ig AS (SELECT item_id, unnest(list_transform(range(1, len(ws) - 8), lambda k: array_to_string(ws[k:k+9], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

ORACLE = {"p8_found": _P8}
