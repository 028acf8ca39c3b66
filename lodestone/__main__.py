"""``python -m lodestone TABLES VERB [ARGUMENT]``: one question, its answer as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestone import tools
from lodestone.api import Engine

NO_ARGUMENT = ("status", "freshness", "pending", "candidates", "prune", "coverage", "gaps", "repairs", "health", "serve")
ONE_ARGUMENT = ("find", "impact", "explain", "context", "find_requirements", "trace", "neighbors", "report")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("tables")
    parser.add_argument("verb", choices=sorted((*NO_ARGUMENT, *ONE_ARGUMENT)))
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--limit", type=int, default=100, help="rows to print")
    given = parser.parse_args(argv)
    if (given.verb in ONE_ARGUMENT) != (given.argument is not None):
        parser.error(f"{given.verb} takes {'one' if given.verb in ONE_ARGUMENT else 'no'} argument")
    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, given.tables)
    if given.verb == "serve":
        for line in tools.serve(engine, sys.stdin):
            print(line, flush=True)
        return
    if given.verb == "report":
        engine.report(given.argument)
        return
    verb = getattr(engine, given.verb)
    answer = verb(given.argument) if given.verb in ONE_ARGUMENT else verb()
    for line in answer.limit(given.limit).toJSON().collect():
        print(line)


if __name__ == "__main__":
    main()
