"""JSON-RPC 2.0 tool endpoint: searches and articles as tools."""

from __future__ import annotations

import json
import secrets
import threading

from .app import NAME, VERSION, App

PROTOCOL = "2024-11-05"
TOOLS = [
    {
        "name": "search",
        "description": "Search the local collection by words and, where enabled, by meaning.",
        "inputSchema": {
            "type": "object",
            "properties": {"query": {"type": "string", "description": "What to look for."}, "limit": {"type": "integer", "description": "Most results to return.", "default": 25}},
            "required": ["query"],
        },
    },
    {
        "name": "article",
        "description": "All sections of an article, by its id.",
        "inputSchema": {"type": "object", "properties": {"id": {"type": "integer", "description": "The article's id."}}, "required": ["id"]},
    },
]


class Sessions:
    """Ids of open sessions."""

    def __init__(self):
        self._open: set[str] = set()
        self._lock = threading.Lock()

    def new(self) -> str:
        with self._lock:
            self._open.add(sid := secrets.token_hex(16))
        return sid

    def __contains__(self, sid: str) -> bool:
        with self._lock:
            return sid in self._open

    def remove(self, sid: str) -> None:
        with self._lock:
            self._open.discard(sid)


def told(text: str, error: bool = False) -> dict:
    return {"content": [{"type": "text", "text": text}], "isError": error}


def number(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def call(app: App, name: str, args: dict) -> dict:
    if name == "search":
        query = args.get("query")
        if not isinstance(query, str) or not query:
            return told("Error: query parameter is empty or missing.", True)
        limit = number(args.get("limit"))
        limit = app.config.limit if limit is None else limit
        try:
            found = app.search(query, limit)
        except Exception as error:  # noqa: BLE001 - told to the caller
            return told(f"Error performing search: {error}", True)
        lines = [f"Search results for '{query}' (limit {limit}):\n"]
        for i, r in enumerate(found, 1):
            lines.append(f"{i}. **{r.get('title', '')}** (Article ID: {r.get('article_id', 0)})\n   Match Score: {r['power']:.2f}%")
            if r["snippet"]:
                lines.append(f"   Snippet: {r['snippet']}")
            lines.append("")
        return told("\n".join(lines) + "\n" if found else lines[0] + "\nNo articles found matching the query.")
    if name == "article":
        if "id" not in args:
            return told("Error: id parameter is missing.", True)
        if (wanted := number(args["id"])) is None:
            return told("Error: id must be an integer.", True)
        try:
            a = app.article(wanted)
        except Exception as error:  # noqa: BLE001 - told to the caller
            return told(f"Error retrieving article ID {wanted}: {error}", True)
        text = f"# {a['title']}\n" + (f"Entity Identifier: {a['entity']}\n" if a["entity"] else "") + "\n"
        for s in a["sections"]:
            text += (f"## {s['title']}\n" if s["title"] else "") + s["content"] + "\n\n"
        return told(text)
    return told(f"Error: Unknown tool {name}", True)


def answer(app: App, request: dict) -> dict | None:
    """The response to a request, or None to a notification."""
    method, params = request.get("method", ""), request.get("params")
    out = {"jsonrpc": "2.0", "id": request.get("id")}
    if method == "notifications/initialized":
        return None
    if method == "initialize":
        capabilities = {"tools": {"listChanged": False}, "prompts": {"listChanged": False}}
        return out | {"result": {"protocolVersion": PROTOCOL, "capabilities": capabilities, "serverInfo": {"name": NAME, "version": VERSION}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "prompts/list":
        return out | {"result": {"prompts": []}}
    if method == "prompts/get":
        return out | {"error": {"code": -32602, "message": "Prompt not found"}}
    if method == "tools/list":
        return out | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        if not isinstance(params, dict) or not isinstance(params.get("arguments") or {}, dict):
            return out | {"error": {"code": -32602, "message": "Invalid params"}}
        return out | {"result": call(app, params.get("name", ""), params.get("arguments") or {})}
    return out | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def parse(body: bytes) -> dict | None:
    try:
        got = json.loads(body)
    except ValueError:
        return None
    return got if isinstance(got, dict) else None
