"""HTTP: the JSON API, the tool endpoint and two plain pages."""

from __future__ import annotations

import html
import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from . import rpc
from .app import ApiError, App


def handler(app: App) -> type[BaseHTTPRequestHandler]:
    sessions = rpc.Sessions()
    searches = app.searches()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            if app.config.log:
                super().log_message(*args)

        def send(self, status: int, body: bytes, kind: str = "application/json", **headers: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            for name, value in headers.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()
            self.wfile.write(body)

        def send_json(self, value: dict, status: int = 200, **headers: str) -> None:
            self.send(status, json.dumps(value, ensure_ascii=False).encode(), **headers)

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def wanted(self, key: str, default: int | None) -> tuple[str, int | None, dict]:
            """The query and a number, from JSON (POST) or parameters (GET)."""
            if self.command == "POST":
                got = rpc.parse(self.body())
                if got is None:
                    raise ApiError("Invalid JSON request", 400)
                value = rpc.number(got.get(key))
                if key == "limit" and (value is None or value <= 0):
                    value = default
                return str(got.get("query") or ""), value if value is not None else default, got
            args = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            if key not in args:
                return args.get("query", ""), default, args
            try:
                return args.get("query", ""), int(args[key]), args
            except ValueError:
                raise ApiError(f"Invalid {'limit' if key == 'limit' else 'ID'} parameter", 400) from None

        def api(self, name: str) -> None:
            began = time.time()
            try:
                if name == "article":
                    _, article_id, _ = self.wanted("id", None)
                    if article_id is None:
                        raise ApiError("ID parameter is required", 400)
                    try:
                        result = {"article": app.article(article_id)}
                    except LookupError as error:
                        raise ApiError(f"Error retrieving article: {error}", 500) from None
                else:
                    if name == "semantic" and not app.ai:
                        raise ApiError("Semantic search is not enabled", 400)
                    query, limit, _ = self.wanted("limit", app.config.limit)
                    if not query:
                        raise ApiError("Query parameter is required", 400)
                    try:
                        result = {"results": searches[name](query, limit)}
                    except ApiError:
                        raise
                    except Exception as error:  # noqa: BLE001 - told to the caller
                        raise ApiError(f"Search error: {error}", 500) from None
            except ApiError as error:
                self.send_json({"status": "error", "message": str(error)}, error.status)
                return
            self.send_json({"status": "success", **result, "time": time.time() - began})

        def page(self, title: str, inner: str, status: int = 200) -> None:
            text = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{inner}</body></html>"
            self.send(status, text.encode(), "text/html; charset=utf-8")

        def home(self) -> None:
            query, limit, _ = self.wanted("limit", app.config.limit) if self.command == "GET" else ({k: v[0] for k, v in parse_qs(self.body().decode()).items()}.get("query", ""), app.config.limit, {})
            inner = f"<form><input name='query' value='{html.escape(query, quote=True)}'><button>Search</button></form>"
            if query:
                # snippets have marks of their own, everything else is escaped
                mark = lambda s: html.escape(s).replace("&lt;mark&gt;", "<mark>").replace("&lt;/mark&gt;", "</mark>")
                inner += "<ol>" + "".join(f"<li><a href='/article?id={r.get('article_id', 0)}'>{html.escape(r.get('title', ''))}</a> {r['power']:.0f}<p>{mark(r['snippet'])}</p></li>" for r in app.search(query, limit)) + "</ol>"
            self.page("Search", inner)

        def article_page(self) -> None:
            try:
                _, article_id, _ = self.wanted("id", 0)
                a = app.article(article_id)
            except (ApiError, LookupError) as error:
                self.page("Article", html.escape(str(error)), 500)
                return
            self.page(a["title"], f"<h1>{html.escape(a['title'])}</h1>" + "".join(f"<h2>{html.escape(s['title'])}</h2><p>{html.escape(s['content'])}</p>" for s in a["sections"]))

        def mcp(self) -> None:
            cors = {"Access_Control_Allow_Origin": "*", "Access_Control_Allow_Methods": "GET, POST, DELETE, OPTIONS", "Access_Control_Allow_Headers": "*"}
            if self.command == "OPTIONS":
                self.send(204, b"", **cors)
            elif self.command == "DELETE":
                sessions.remove(self.headers.get("Mcp-Session-Id", ""))
                self.send(200, b"", **cors)
            elif self.command == "GET":
                # nothing is ever pushed: the stream only keeps the connection known
                self.send(200, b": keep-alive\n\n", "text/event-stream", Mcp_Session_Id=sessions.new(), **cors)
            elif self.command == "POST":
                request = rpc.parse(self.body())
                if request is None:
                    self.send_json({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}, 400, **cors)
                    return
                sid = {"Mcp_Session_Id": sessions.new()} if request.get("method") == "initialize" else {}
                response = rpc.answer(app, request)
                if response is None:
                    self.send(202, b"", **cors)
                else:
                    self.send_json(response, **sid, **cors)
            else:
                self.send_json({"error": "Method not allowed"}, 405)

        def route(self) -> None:
            path = urlsplit(self.path).path.rstrip("/") or "/"
            if path == "/mcp":
                self.mcp()
            elif path == "/":
                self.home()
            elif path == "/article":
                self.article_page()
            elif path == "/api/article":
                self.api("article")
            elif path == "/api/search" or path.startswith("/api/search/") and path[12:] in searches:
                self.api(path[12:])
            else:
                self.send_json({"status": "error", "message": "Not found"}, 404)

        do_GET = do_POST = do_DELETE = do_OPTIONS = route

    return Handler


def server(app: App) -> ThreadingHTTPServer:
    made = ThreadingHTTPServer((app.config.web_host, app.config.web_port), handler(app))
    if app.config.web_tls_private and app.config.web_tls_public:
        import ssl

        context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
        context.load_cert_chain(app.config.web_tls_public, app.config.web_tls_private)
        made.socket = context.wrap_socket(made.socket, server_side=True)
    return made
