"""Vocabulary of the graph: kinds, relations, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation kinds and their other accepted spelling.
SEMANTIC = ("implements", "enforces", "covered_by", "depends_on", "satisfies")
STRUCTURAL = ("contains", "calls", "references", "reads_from", "writes_to", "defines_schema", "exposes", "calls_external", "emits", "handles")
# Node kinds.
INTENTS = ("feature", "requirement", "invariant", "decision")
EXPANDING = ("requirement", "invariant", "decision", "domain_concept")
LIVE_STATUS = ("active", "accepted", "approved")
RETIRED_STATUS = ("deprecated", "superseded", "rejected", "draft", "proposed")
BUCKETS = {
    "feature": "features",
    "requirement": "requirements",
    "invariant": "invariants",
    "decision": "decisions",
    "db_entity": "data_contracts",
    "external_system": "data_contracts",
    "endpoint": "data_contracts",
    "event": "data_contracts",
    "api_endpoint": "api_contracts",
    "file": "implementation",
}
WEAK_BP = 6500
HOPS = 3


def relation(kind: Column) -> Column:
    """A relation kind in its underscored spelling, whatever the case or spelling stored."""
    bare = F.lower(F.regexp_replace(kind, r"[\s_]", ""))
    out = F.lit(None).cast("string")
    for name in (*SEMANTIC, *STRUCTURAL):
        out = F.when(bare == name.replace("_", ""), name).otherwise(out)
    return F.coalesce(out, bare)


def state(status: Column) -> Column:
    return F.lower(F.regexp_replace(status, r"\s", ""))


def bucket(kind: Column, is_test: Column) -> Column:
    """The part of an impact report a node belongs to; null where it belongs to none."""
    out = F.lit(None).cast("string")
    for k, b in BUCKETS.items():
        out = F.when(kind == k, b).otherwise(out)
    return F.when((kind == "code_symbol") & is_test, "tests").when(kind == "code_symbol", "implementation").otherwise(out)
