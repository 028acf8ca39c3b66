"""Spark-first analytics over a versioned, evidence-backed product graph."""
