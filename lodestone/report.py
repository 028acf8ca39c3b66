"""The report of a project: datasets that are bounded by what a page can show, and a static site of them."""

from __future__ import annotations

import html
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans import graph_queries
from lodestone.session import read
from lodestone.sources import export
from lodestone.sources.graph import Graph, load

MARK = ".lodestone-report"
PAGE = 500
CATALOG = ("feature", "requirement", "invariant", "decision", "domain_concept", "event", "api_endpoint", "db_entity")


def catalogs(graph: Graph) -> DataFrame:
    return graph.nodes.filter(F.col("kind").isin(*CATALOG)).select("kind", "identifier", "name", "status", "stable_key")


def between(graph: Graph, kinds: tuple[str, ...] = CATALOG) -> DataFrame:
    """Claims of which both ends are in the catalogs."""
    keys = graph.nodes.filter(F.col("kind").isin(*kinds)).select("stable_key")
    e = graph.edges.join(keys.withColumnRenamed("stable_key", "src"), "src", "left_semi").join(keys.withColumnRenamed("stable_key", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "kind", "status").distinct()


def datasets(spark, tables: str) -> dict[str, DataFrame]:
    """All parts of the report by name; frames, nothing is drawn yet."""
    graph = load(spark, tables)
    return {
        "status": graph_queries.status_counts(spark, tables), "catalog": catalogs(graph), "graph": between(graph), "tree": graph_queries.directory_tree(spark, tables),
        "search": export.search_rows(graph), "unmapped": graph_queries.unmapped_intents(spark, tables), "stale": graph_queries.stale_claims(spark, tables),
        "endpoints": export.offered_endpoints(read(spark, tables, "endpoints")).drop("params"),
    }


def page(name: str, columns: list[str], rows: list[tuple], more: bool) -> str:
    """One dataset as an HTML page."""
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "\n".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows)
    note = f"<p>The first {PAGE} rows; the whole is in {html.escape(name)}.jsonl.</p>" if more else ""
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(name)}</title><h1>{html.escape(name)}</h1>{note}<table><thead><tr>{head}</tr></thead><tbody>\n{body}\n</tbody></table>\n"


def write_site(parts: dict[str, DataFrame], folder: str) -> None:
    """Write the site whole or not at all; a folder that holds anything else is refused.

    Pages show ``PAGE`` rows, whole datasets go into JSON lines row by row.
    """
    folder = os.path.abspath(folder)
    if os.path.exists(folder) and os.listdir(folder) and not os.path.exists(os.path.join(folder, MARK)):
        raise FileExistsError(f"{folder} holds something that is no report")
    os.makedirs(os.path.dirname(folder), exist_ok=True)
    made = tempfile.mkdtemp(prefix=".report-", dir=os.path.dirname(folder))
    try:
        open(os.path.join(made, MARK), "w").close()
        for name, df in parts.items():
            shown, count = [], 0
            with open(os.path.join(made, f"{name}.jsonl"), "w", encoding="utf-8") as out:
                for row in df.orderBy(*df.columns).toLocalIterator():
                    count += 1
                    if count <= PAGE:
                        shown.append(tuple(row))
                    out.write(json.dumps(row.asDict(True), default=str, ensure_ascii=False) + "\n")
            with open(os.path.join(made, f"{name}.html"), "w", encoding="utf-8") as out:
                out.write(page(name, df.columns, shown, count > PAGE))
        with open(os.path.join(made, "index.html"), "w", encoding="utf-8") as out:
            out.write("<!doctype html><meta charset=utf-8><title>Report</title><ul>" + "".join(f'<li><a href="{n}.html">{n}</a>' for n in parts) + "</ul>\n")
        if os.path.exists(folder):
            shutil.rmtree(folder)
        os.rename(made, folder)
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise
