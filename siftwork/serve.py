"""The four tools as a server that speaks JSON-RPC over standard input and output, one message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import SparkSession

from siftwork import api
from siftwork.errors import SiftworkError

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER, _YES = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
#: By name: what it does, its parameters, those that it needs, and the call.
TOOLS: dict[str, tuple[str, dict, list[str], Callable[..., str]]] = {
    "pack_context": (
        "Choose the files of a corpus that are worth most under a token budget, and give their text.",
        {"repo": _TEXT, "budget": _NUMBER, "output": _TEXT, "focus": {"type": "array", "items": _TEXT}, "include_signatures": _YES},
        ["repo"],
        lambda spark, a: api.pack_context(spark, a["repo"], 128_000 if a.get("budget") is None else int(a["budget"]), a.get("output") or "l3", a.get("focus") or (), bool(a.get("include_signatures"))),
    ),
    "index_stats": ("Count the files, tokens and languages of a corpus.", {"repo": _TEXT}, ["repo"], lambda spark, a: api.index_stats(spark, a["repo"])),
    "submit_feedback": (
        "Measure how much of each packed file a response used, and keep it.",
        {"session_id": _TEXT, "llm_response": _TEXT, "repo": _TEXT},
        ["session_id", "llm_response", "repo"],
        lambda spark, a: api.submit_feedback(spark, a["repo"], a["session_id"], a["llm_response"]),
    ),
    "learned_weights": (
        "Give the scoring weights learned so far, after a learning cycle if asked for.",
        {"repo": _TEXT, "run_learning": _YES},
        ["repo"],
        lambda spark, a: api.learned_weights(spark, a["repo"], bool(a.get("run_learning"))),
    ),
}


def _call(spark: SparkSession, params: dict) -> dict:
    if not isinstance(params, dict) or not isinstance(name := params.get("name"), str) or (tool := TOOLS.get(name)) is None:
        raise KeyError("no such tool")
    args = params.get("arguments") or {}
    if not isinstance(args, dict):
        raise KeyError("arguments must be an object")
    if lacking := [k for k in tool[2] if k not in args]:
        raise KeyError(f"missing: {', '.join(lacking)}")
    try:
        return {"content": [{"type": "text", "text": tool[3](spark, args)}], "isError": False}
    except Exception as e:  # noqa: BLE001
        # What a tool meets (a folder that is gone, an argument of another kind, a failed job) is the caller's to know and must not end the server.
        said = str(e) if isinstance(e, SiftworkError) else f"{type(e).__name__}: {e}"
        return {"content": [{"type": "text", "text": said[:2000]}], "isError": True}


def answer(spark: SparkSession, message: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params, number = message.get("method"), message.get("params") or {}, message.get("id")
    if number is None:
        return None
    result: Any
    try:
        if method == "initialize":
            result = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "siftwork", "version": "1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": k, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for k, (d, p, r, _) in TOOLS.items()]}
        elif method == "tools/call":
            result = _call(spark, params)
        else:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method: {method}"}}
    except KeyError as e:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e.args[0])}}
    return {"jsonrpc": "2.0", "id": number, "result": result}


def serve(spark: SparkSession, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            reply = answer(spark, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
