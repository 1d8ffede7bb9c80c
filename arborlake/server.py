"""The commands as tools of a Model Context Protocol server: JSON-RPC, one message a line, over two streams."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterator
from typing import TextIO

import arborlake
from arborlake.plans import commands, reports
from arborlake.plans.index import Store

PROTOCOL, ROWS = "2024-11-05", 50
_KINDS = {int: "integer", float: "number", bool: "boolean", str: "string"}


def tools() -> list[dict]:
    """One tool a command, with a schema from its signature."""
    out = []
    for name, f in commands.COMMANDS.items():
        fields, needed = {}, []
        for k, arg in list(inspect.signature(f).parameters.items())[1:]:
            if k == "paths":
                fields[k] = {"type": "array", "items": {"type": "string"}}
                needed.append(k)
            elif arg.default is inspect.Parameter.empty:
                fields[k] = {"type": "string"}
                needed.append(k)
            else:
                fields[k] = {"type": _KINDS[type(arg.default)]} if arg.default is not None else {}
        what = (f.__doc__ or f"The report {name}.").split("\n")[0]
        out.append({"name": name, "description": what, "inputSchema": {"type": "object", "properties": fields, "required": needed}})
    return out


def call(store: Store, name: str, arguments: dict, project: str = "") -> str:
    """A command's report as JSON text."""
    known = list(inspect.signature(commands.COMMANDS[name]).parameters)[1:]
    unknown = [k for k in arguments if k not in known]
    if unknown:
        raise ValueError(f"{name} has no argument {', '.join(unknown)}")
    r = commands.COMMANDS[name](store, **arguments)
    shown = {k: [x.asDict(recursive=True) for x in df.limit(ROWS).collect()] for k, df in r.tables.items()}
    return reports.dump(reports.envelope(r.command, r.summary, shown, project))


def answer(store: Store, message: dict, project: str = "") -> dict | None:
    """The response to one request; none to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "arborlake", "version": arborlake.__version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": tools()}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    if params.get("name") not in commands.COMMANDS:
        return reply | {"error": {"code": -32602, "message": f"unknown tool {params.get('name')}"}}
    try:
        text, failed = call(store, params["name"], params.get("arguments") or {}, project), False
    except Exception as e:  # noqa: BLE001  a tool's failure is its result; the server goes on
        text, failed = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def messages(source: TextIO) -> Iterator[dict | None]:
    """Requests as they come; None for what is no JSON object."""
    for line in source:
        if line.strip():
            try:
                m = json.loads(line)
            except ValueError:
                m = None
            yield m if isinstance(m, dict) else None


def serve(store: Store, source: TextIO, sink: TextIO, project: str = "") -> int:
    for m in messages(source):
        reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON object"}} if m is None else answer(store, m, project)
        if reply is not None:
            sink.write(json.dumps(reply, default=str) + "\n")
            sink.flush()
    return 0
