"""HTTP service over an engine: statements, lookups, algorithms, health and metrics, as JSON envelopes.

Statements are planned one at a time, since they may change the catalog or the session; their results are
computed side by side.  An answer holds at most ``rows`` rows: larger results belong in a table.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .engine import Engine
from .metrics import Metrics, prometheus, storage
from .sources import sinks

JSON, TEXT = "application/json", "text/plain; version=0.0.4"
#: Longest body of a request, in bytes, and the depth of path searches unless one is given.
LONGEST, DEPTH = 1 << 20, 10


class Problem(Exception):
    """An answer with an error status."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def number(body: dict[str, Any], name: str, default: int | None = None) -> int:
    value = body.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise Problem(400, f"{name} must be a number of 0 or more")
    return value


class Service:
    """``answer`` maps a request to (status, content type, text) without a socket."""

    def __init__(self, engine: Engine, metrics: Metrics | None = None, rows: int = sinks.SHOWN):
        self.engine, self.metrics, self.rows = engine, metrics or Metrics(), rows
        self.planning = threading.Lock()
        vertex, edges = "vertices_queried", "edges_queried"
        self.routes: list[tuple[str, str, Callable[..., tuple[int, str, str]]]] = [
            ("GET", r"/health", lambda: (200, JSON, json.dumps({"status": "ok"}))),
            ("GET", r"/metrics", lambda: (200, TEXT, prometheus(self.metrics.snapshot() | storage(self.engine.spark)))),
            ("GET", r"/stats", self.stats),
            ("POST", r"/query", lambda body: self.shown(lambda: self.planned(body))),
            ("GET", r"/vertices/(\d+)", lambda i: self.found(vertex, lambda g: g.vertex(int(i)), f"no vertex {i}")),
            ("GET", r"/vertices/address/([^/]+)", lambda a: self.found(vertex, lambda g: g.vertex_by_address(unquote(a)), f"no vertex at {unquote(a)}")),
            ("GET", r"/edges/(\d+)", lambda i: self.found(edges, lambda g: g.edge(int(i)), f"no edge {i}")),
            ("GET", r"/vertices/(\d+)/outgoing", lambda i: self.found(edges, lambda g: g.outgoing(int(i)))),
            ("GET", r"/vertices/(\d+)/incoming", lambda i: self.found(edges, lambda g: g.incoming(int(i)))),
            ("POST", r"/algorithm/shortest-path", lambda b: self.called("shortest_path", b, "source", "target", none="no path")),
            ("POST", r"/algorithm/all-paths", lambda b: self.called("all_paths", b, "source", "target", more=[number(b, "max_depth", DEPTH), self.rows])),
            ("POST", r"/algorithm/max-flow", lambda b: self.called("max_flow", b, "source", "sink", more=[self.rows])),
            ("POST", r"/algorithm/trace", lambda b: self.called("trace", b, "start", more=[self.direction(b), number(b, "max_depth", DEPTH), self.rows])),
        ]

    # -- answers --------------------------------------------------------------
    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, str, str]:
        """Unknown paths are 404, wrong methods 405, faulty bodies and statements 400, failed jobs 500."""
        at = urlsplit(path).path
        try:
            known = [(verb, hit, run) for verb, pattern, run in self.routes if (hit := re.fullmatch(pattern, at))]
            if not known:
                raise Problem(404, f"no such path: {at}")
            for verb, hit, run in known:
                if verb == method:
                    return run(self.read(body)) if verb == "POST" else run(*hit.groups())
            raise Problem(405, f"{at} takes {known[0][0]}")
        except Problem as e:
            return e.status, JSON, sinks.envelope(None, str(e))
        except ValueError as e:
            return 400, JSON, sinks.envelope(None, str(e))
        except PySparkException as e:
            return 500, JSON, sinks.envelope(None, str(e))

    def read(self, body: bytes) -> dict[str, Any]:
        try:
            got = json.loads(body)
        except ValueError as e:
            raise Problem(400, f"the body is no JSON: {e}") from e
        if not isinstance(got, dict):
            raise Problem(400, "the body must be a JSON object")
        return got

    def shown(self, plan: Callable[[], DataFrame], none: str | None = None, status: int = 404) -> tuple[int, str, str]:
        """The rows of a result; ``none`` is the error, under this status, if there are none."""
        with self.metrics.query():
            with self.planning:
                df = plan()
            text = sinks.envelope(df, rows=self.rows)
        if none is not None and not json.loads(text)["data"]:
            raise Problem(status, none)
        return 200, JSON, text

    def planned(self, body: dict[str, Any]) -> DataFrame:
        text, params = body.get("query"), body.get("params")
        if not isinstance(text, str) or not isinstance(params, dict | None):
            raise Problem(400, "query must be a text, and params an object if given")
        return self.engine.gql(text, params)

    def found(self, what: str, look: Callable[[Any], DataFrame], none: str | None = None) -> tuple[int, str, str]:
        self.metrics.add(what)
        return self.shown(lambda: look(self.engine.graph), none)

    def called(self, name: str, body: dict[str, Any], *ends: str, more: list[Any] | None = None, none: str | None = None) -> tuple[int, str, str]:
        args = [*(number(body, e) for e in ends), *(more or [])]
        return self.shown(lambda: self.engine.call(name, *args), none, 200)

    def direction(self, body: dict[str, Any]) -> str:
        got = body.get("direction", "forward")
        if got not in ("forward", "backward", "both"):
            raise Problem(400, "direction must be forward, backward or both")
        return got

    def stats(self) -> tuple[int, str, str]:
        n = self.metrics.snapshot()
        query = {k: n[k] for k in ("total", "success", "failed", "avg_duration_ms", "slow_queries", "qps")}
        graph = {k: n[k] for k in ("vertices_queried", "edges_queried")}
        return 200, JSON, json.dumps({"query": query, "storage": storage(self.engine.spark), "graph": graph, "system": {"uptime_seconds": n["uptime_seconds"]}})

    # -- sockets --------------------------------------------------------------
    def server(self, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
        """A bound server; ``serve_forever`` runs it, ``shutdown`` ends it."""
        service = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, status: int, kind: str, text: str) -> None:
                data = text.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self.reply(*service.answer("GET", self.path))

            def do_POST(self) -> None:
                size = self.headers.get("Content-Length") or "0"
                if not size.isdecimal() or int(size) > LONGEST:
                    self.close_connection = True
                    self.reply(413, JSON, sinks.envelope(None, f"a body has at most {LONGEST} bytes"))
                    return
                self.reply(*service.answer("POST", self.path, self.rfile.read(int(size))))

            def log_message(self, *args: Any) -> None:
                """Requests are counted, not printed."""

        return ThreadingHTTPServer((host, port), Handler)
