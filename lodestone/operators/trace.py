"""What an endpoint leads to across services, within shared budgets.

Budgets are spent depth first, so the walk is sequential; it crosses 8 services at most. Three
jobs a crossing fetch what the walk can spend there, all of a handler's edges and the answers to
all of its calls at once, by filters that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODES, BRANCHES, TRANSITIONS = 50, 16, 8


@dataclass
class Budget:
    nodes: int = NODES
    branches: int = BRANCHES
    transitions: int = TRANSITIONS
    visited: set = field(default_factory=set)

    def node(self) -> bool:
        self.nodes -= 1
        return self.nodes >= 0


ROWS = "path string, depth int, service string, kind string, target string, stopped string"


class Tracer:
    """``edges``: service, src, dst, kind, status; ``calls``: service, key, method, route (null: opaque);
    ``endpoints``: service, key, method, route; ``overrides``: method, route, neighbor (null: none)."""

    def __init__(self, edges: DataFrame, calls: DataFrame, endpoints: DataFrame, overrides: DataFrame | None = None):
        self.edges, self.calls, self.endpoints, self.overrides = edges, calls, endpoints, overrides

    def _handler(self, service: str, key: str) -> tuple[str, str] | None:
        """The least exposing source of an endpoint and the state of that claim."""
        at = self.edges.filter((F.col("service") == service) & (F.col("dst") == key) & (F.col("kind") == "exposes"))
        least = at.agg(F.min(F.struct("src", "status")).alias("h")).first()["h"]
        return (least["src"], least["status"]) if least else None

    def _around(self, service: str, handler: str) -> dict[str, list[str]]:
        """Targets of a handler by kind, in order; as many as can be spent."""
        out = self.edges.filter((F.col("service") == service) & (F.col("src") == handler) & (F.col("status") == "active") & F.col("kind").isin("reads_from", "writes_to", "calls_external"))
        ranked = out.select("kind", "dst").distinct().withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("dst")))
        found: dict[str, list[str]] = {}
        for r in ranked.filter(F.col("n") <= NODES + 1).orderBy("kind", "n").collect():
            found.setdefault(r["kind"], []).append(r["dst"])
        return found

    def _answers(self, service: str, keys: list[str]) -> dict[str, tuple[int, tuple[str, str] | None]]:
        """For each call how many services answer it, and the least endpoint that does; a decision on
        its shape leaves the neighbour it names. Calls without a route have no row."""
        own = self.calls.filter((F.col("service") == service) & F.col("key").isin(keys)).groupBy("key").agg(F.min(F.struct("method", "route")).alias("c"))
        own = own.select(F.col("key").alias("call"), "c.method", "c.route").filter("route is not null")
        j = own.join(self.endpoints.filter(F.col("service") != service).select("service", "key", "method", "route").distinct(), ["method", "route"], "left")
        if self.overrides is not None:
            chosen = self.overrides.groupBy("method", "route").agg(F.min(F.struct("neighbor")).alias("o"))
            j = j.join(chosen, ["method", "route"], "left")
            j = j.withColumn("service", F.when(F.col("o").isNull() | F.col("service").eqNullSafe(F.col("o.neighbor")), F.col("service")))
        one = F.min(F.when(F.col("service").isNotNull(), F.struct("service", "key"))).alias("first")
        return {r["call"]: (r["n"], tuple(r["first"]) if r["first"] else None) for r in j.groupBy("call").agg(F.countDistinct("service").alias("n"), one).collect()}

    def trace(self, service: str, key: str, budget: Budget | None = None) -> DataFrame:
        """Rows in the order of the walk; ``stopped`` names why one leads no further."""
        rows: list[tuple] = []
        self._endpoint(service, key, budget or Budget(), "0", 0, rows)
        return self.edges.sparkSession.createDataFrame(rows, ROWS)

    def _endpoint(self, service: str, key: str, b: Budget, path: str, depth: int, rows: list) -> None:
        add = lambda kind, target, stopped=None, p=path: rows.append((p, depth, service, kind, target, stopped))
        if (service, key) in b.visited:
            return add("endpoint", key, "cycle")
        b.visited.add((service, key))
        if not b.node():
            return add("endpoint", key, "node_cap_reached")
        exposed = self._handler(service, key)
        if not exposed or exposed[1] != "active":
            return add("endpoint", key, "retired_fact")
        add("endpoint", key)
        handler = exposed[0]
        if not b.node():
            return add("handler", handler, "node_cap_reached")
        add("handler", handler)
        around = self._around(service, handler)
        for kind in ("reads_from", "writes_to"):
            for target in around.get(kind, []):
                if not b.node():
                    return add(kind, target, "node_cap_reached")
                add(kind, target)
        calls = around.get("calls_external", [])
        answers = self._answers(service, calls[: BRANCHES + 1]) if calls and b.branches and b.transitions else {}
        for n, target in enumerate(calls):
            self._call(service, target, answers, b, f"{path}.{n}", depth, rows)

    def _call(self, service: str, key: str, answers: dict, b: Budget, path: str, depth: int, rows: list) -> None:
        add = lambda stopped: rows.append((path, depth, service, "call", key, stopped))
        if b.branches == 0:
            return add("branch_cap_reached")
        b.branches -= 1
        if b.transitions == 0:
            return add("service_transition_cap_reached")
        services, first = answers.get(key, (0, None))
        if first is None:
            return add("unmatched")
        if services > 1:
            return add("ambiguous")
        b.transitions -= 1
        add(None)
        self._endpoint(first[0], first[1], b, path, depth + 1, rows)


def size(rows: DataFrame) -> int:
    """Nodes of a trace: everything it names but the calls it stopped at."""
    return rows.filter("kind <> 'call' or stopped is null").count()
