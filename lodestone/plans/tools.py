"""The engine as a JSON-RPC tool server, one message a line."""

from __future__ import annotations

import json
import sys

from lodestone.plans.engine import MODES, Engine

#: Fixed codes of JSON-RPC 2.0.
PARSE_ERROR, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32601, -32602, -32603
PROTOCOL = "2024-11-05"

_TEXT = {"type": "string"}
TOOLS = {
    "search_code": ("Ranked search by meaning and words.", {"query": _TEXT, "top_k": {"type": "integer", "minimum": 1, "maximum": 50}, "path": _TEXT, "mode": {"type": "string", "enum": list(MODES)}}, ["query"]),
    "find_symbol": ("Where a name is defined; complete.", {"name": _TEXT}, ["name"]),
    "find_references": ("Files that define and that refer to a name; complete.", {"name": _TEXT}, ["name"]),
    "outline": ("Symbols of a file in line order.", {"file": _TEXT}, ["file"]),
    "index_status": ("Size and health of the index.", {}, []),
}


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class ToolServer:
    def __init__(self, engine: Engine):
        self.engine = engine

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            raise Failure(BAD_PARAMS, f"no tool {name}")
        _, known, needed = TOOLS[name]
        if missing := [k for k in needed if not given.get(k)]:
            raise Failure(BAD_PARAMS, f"{name} needs {', '.join(missing)}")
        try:
            result = getattr(self.engine, name)(**{k: v for k, v in given.items() if k in known})
        except Exception as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(result, ensure_ascii=False, default=str)}]}

    def _answer(self, method: str, params: dict):
        if method == "initialize":
            return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            return self._call(params)
        raise Failure(NO_METHOD, f"no method {method}")

    def handle(self, line: str) -> dict | None:
        """The reply to a message; None to a notification."""
        try:
            message = json.loads(line)
            if not isinstance(message, dict):
                raise ValueError
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "no JSON object"}}
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            return reply | {"result": self._answer(message.get("method"), message.get("params") or {})}
        except Failure as e:
            return reply | {"error": {"code": e.code, "message": str(e)}}
        except Exception as e:
            return reply | {"error": {"code": INTERNAL, "message": str(e)}}

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip() and (reply := self.handle(line)) is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)


def status_line(status: dict, warn: int = 75) -> str:
    """The state of an index in a line."""
    if not status["files"]:
        return "no index"
    parts = [f"{status['files']} files", f"{status['chunks']} chunks", status["status"]]
    percent = (status.get("coverage") or {}).get("percent")
    if percent is not None:
        parts.append(f"{percent} % covered" + (" (low)" if percent < warn else ""))
    if status.get("dimension_mismatch"):
        parts.append("vectors of other dimensions: reindex")
    return ", ".join(parts)


def session_text(status: dict) -> str:
    """What a new session is told: the tools and the size of the index; nothing while it cannot answer."""
    if not status["ok"] or not status["files"]:
        return ""
    shown = [n for n in TOOLS if status.get("symbol_graph") or n not in ("find_symbol", "find_references", "outline")]
    lines = [f"This tree is indexed: {status['files']} files, {status['chunks']} chunks. Tools:"]
    return "\n".join([*lines, *(f"- {n}({', '.join(TOOLS[n][2])}): {TOOLS[n][0]}" for n in shown)]) + "\n"
