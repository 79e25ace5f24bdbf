"""Command line, and JSON-RPC over standard input and output.

    python -m quarryline.cli --store DIR --root DIR index | search QUERY | fetch ID | fact TYPE TEXT | facts [TYPE] | stats [--since 24h] | vacuum | serve
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import IO

from pyspark.sql import SparkSession

from quarryline import __version__
from quarryline.api import Engine

#: Error codes and version of the protocol, and below the names of its tools.
PARSE_ERROR, FAILED = -32700, -32603
PROTOCOL = "2024-11-05"

_TEXT = {"type": "string"}


def _tool(description: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> dict:
    return {"description": description, "inputSchema": {"type": "object", "properties": {k: _TEXT for k in (*required, *optional)}, "required": list(required)}}


TOOLS = {
    "search": _tool("Search the graph; answers with pointers, not contents.", ("query",)),
    "fetch": _tool("The content of a node.", ("node_id",)),
    "index": _tool("Bring the graph up to date with the workspace."),
    "stats": _tool("Token savings of the session, of today and of all time, or of the time since (12h, 7d).", optional=("since",)),
    "fact": _tool("Record a fact.", ("fact_type", "content")),
    "facts": _tool("Active facts, newest first.", optional=("fact_type",)),
    "validate_env": _tool("Whether an environment variable is known, or what it may have meant.", ("env_var",)),
    "check_consistency": _tool("Variables used but not defined, or defined but not used."),
}


def call(engine: Engine, name: str, args: dict):
    """Run a tool; its answer is plain data."""
    get = lambda k: str(args.get(k) or "")
    tools = {
        "search": lambda: engine.search(get("query")), "fetch": lambda: engine.fetch(get("node_id")), "index": engine.index, "stats": lambda: engine.stats(args.get("since")),
        "fact": lambda: engine.add_fact(get("fact_type"), get("content")), "facts": lambda: [r.asDict() for r in engine.facts(args.get("fact_type")).collect()],
        "validate_env": lambda: engine.validate_env(get("env_var")), "check_consistency": engine.check_consistency, "vacuum": engine.vacuum,
    }
    if name not in tools:
        raise LookupError(f"unknown tool: {name}")
    return tools[name]()


def respond(engine: Engine, line: str) -> dict | None:
    """The answer to one request line; None for notifications."""
    try:
        request = json.loads(line)
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"parse error: {e}"}}
    method, params, out = request.get("method", ""), request.get("params") or {}, {"jsonrpc": "2.0", "id": request.get("id")}
    if method.startswith("notifications/"):
        return None
    try:
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "quarryline", "version": __version__}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, **t} for n, t in TOOLS.items()]}
        elif method == "tools/call":
            answer = call(engine, params.get("name", ""), params.get("arguments") or {})
            result = {"content": [{"type": "text", "text": json.dumps(answer, default=str, indent=2)}]}
        else:
            raise LookupError(f"unknown method: {method}")
    except Exception as e:  # every failure is the client's to read
        return out | {"error": {"code": FAILED, "message": str(e)}}
    return out | {"result": result}


def serve(engine: Engine, source: IO[str], sink: IO[str], every: float = 300.0) -> None:
    stop = engine.reindex_every(every)
    for line in source:
        if line.strip() and (answer := respond(engine, line)) is not None:
            print(json.dumps(answer), file=sink, flush=True)
    if stop:
        stop.set()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarryline")
    p.add_argument("--store", required=True)
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (("index",), ("search", "query"), ("fetch", "node_id"), ("fact", "fact_type", "content"), ("validate_env", "env_var"), ("check_consistency",), ("vacuum",)):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
    sub.add_parser("facts").add_argument("fact_type", nargs="?")
    sub.add_parser("stats").add_argument("--since")
    sub.add_parser("serve").add_argument("--every", type=float, default=300.0)
    a = vars(p.parse_args(argv))
    spark = SparkSession.builder.appName("quarryline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.pop("store"), a.pop("root"))
    command = a.pop("command")
    if command == "serve":
        serve(engine, sys.stdin, sys.stdout, a["every"])
    else:
        print(json.dumps(call(engine, command, a), default=str, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
