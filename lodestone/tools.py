"""The engine's questions as tools of a line protocol: one JSON-RPC request a line, one answer a line."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from lodestone.api import Engine

ROWS = 25
# Tools, what they take, and what they say they do.
TOOLS = {
    "find": ("target", "Nodes that a name means"), "impact": ("target", "What a change of a target reaches"), "explain": ("target", "Claims around a target, or between two"),
    "context": ("task", "What fits a task and a token budget"), "find_requirements": ("query", "Intents that share words with a query"), "trace": ("route", "What an endpoint leads to"),
    "status": (None, "Counts of the graph"), "freshness": (None, "Whether the index is at the newest commit"), "coverage": (None, "Share of symbols that claims map"), "gaps": (None, "Intents without an implementation"),
}


def described() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {a: {"type": "string"}} if a else {}, "required": [a] if a else []}} for n, (a, d) in TOOLS.items()]


def execute(engine: Engine, name: str, arguments: dict) -> list[dict]:
    """The first ``ROWS`` rows of a tool's answer; an unknown tool or a missing argument raises."""
    if name not in TOOLS:
        raise LookupError(f"{name} is no tool")
    wanted = TOOLS[name][0]
    if wanted and not str(arguments.get(wanted) or "").strip():
        raise ValueError(f"{name} needs {wanted}")
    answer = getattr(engine, name)(*([str(arguments[wanted])] if wanted else []))
    return [r.asDict(True) for r in answer.limit(ROWS).collect()]


def serve(engine: Engine, lines: Iterable[str], run: Callable = execute) -> Iterator[str]:
    """Answers to requests; whatever goes wrong with one is its answer, and the next is read."""
    for line in lines:
        if not line.strip():
            continue
        number = None
        try:
            request = json.loads(line)
            number = request.get("id")
            if request["method"] == "initialize":
                result: object = {"serverInfo": {"name": "lodestone"}, "capabilities": {"tools": {}}}
            elif request["method"] == "tools/list":
                result = {"tools": described()}
            elif request["method"] == "tools/call":
                rows = run(engine, request["params"]["name"], request["params"].get("arguments") or {})
                result = {"content": [{"type": "text", "text": json.dumps(rows, default=str)}]}
            else:
                raise LookupError(f"{request['method']} is no method")
            yield json.dumps({"jsonrpc": "2.0", "id": number, "result": result})
        except Exception as e:  # the protocol answers every request
            yield json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": -32000, "message": str(e)}})
