"""The graph over MCP: JSON-RPC 2.0, a message a line."""

from __future__ import annotations

import json
from typing import Any, TextIO

from graphloom import __version__
from graphloom.render import render_prompt
from graphloom.store import Store

PROTOCOL = "2024-11-05"


def _tool(name: str, about: str, **properties: Any) -> dict:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": {"symbol": {"type": "string"}} | properties, "required": ["symbol"]}}


TOOLS = [
    _tool("enumerate", "How many callers and definitions a symbol has, by label."),
    _tool("closure", "Definitions of a symbol with their direct callers and callees.", depth={"type": "integer"}),
    _tool(
        "bundle", "Context for a change: target body, callee signatures, call-site snippets, and a report of what was left out.",
        budget={"type": "integer"}, max_callers={"type": "integer"}, format={"type": "string", "enum": ["json", "prompt"]},
    ),
]


def _call(store: Store, name: str, args: dict) -> Any:
    symbol = args.get("symbol")
    if not isinstance(symbol, str):
        raise ValueError("missing required argument: symbol")
    match name:
        case "enumerate":
            return store.enumerate(symbol)
        case "closure":
            return store.closure(symbol, args.get("depth", 1))
        case "bundle":
            shape = args.get("format", "json")
            if shape not in ("json", "prompt"):
                raise ValueError(f'unknown format {shape!r} (expected "json" or "prompt")')
            b = store.bundle(symbol, args.get("budget", 16000), args.get("max_callers", 20))
            return render_prompt(b) if shape == "prompt" else b
    raise ValueError(f"unknown tool: {name}")


def handle(store: Store, request: Any) -> dict | None:
    """The reply to one message; failures of a tool are replies too."""
    request = request if isinstance(request, dict) else {}
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
    match request.get("method"):
        case "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": __version__}}}
        case "notifications/initialized":
            return None
        case "tools/list":
            return reply | {"result": {"tools": TOOLS}}
        case "tools/call":
            params = request.get("params") or {}
            try:
                store.refresh()
                value = _call(store, params.get("name", ""), params.get("arguments") or {})
                text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
                return reply | {"result": {"content": [{"type": "text", "text": text}]}}
            except Exception as e:  # told to the client, whatever it is
                return reply | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
        case method:
            return reply | {"error": {"code": -32601, "message": f"method not found: {method or ''}"}}


def serve(store: Store, lines: TextIO, out: TextIO) -> None:
    """Until the input ends; messages without an id get no reply."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
        except ValueError as e:
            answer: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}}
        else:
            answer = handle(store, request)
            if not (isinstance(request, dict) and "id" in request):
                answer = None
        if answer is not None:
            out.write(json.dumps(answer, ensure_ascii=False) + "\n")
            out.flush()
