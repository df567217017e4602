"""A thin HTTP adapter of the engine."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from loghaven.engine import Engine

MOST_BODY = 5 * 1024 * 1024


def make_server(engine: Engine, host: str = "0.0.0.0", port: int = 8545, timeout: float = 120.0) -> ThreadingHTTPServer:
    """POST / for JSON-RPC, GET /health; start it with ``serve_forever``."""

    seconds = timeout

    class Handler(BaseHTTPRequestHandler):
        timeout = seconds  # of a read, a write or an idle connection

        def _send(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path.split("?")[0] == "/health":
                status, body = engine.health()
                self._send(status, json.dumps(body))
            else:
                self._send(404, "{}")

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BODY:
                self._send(413, "{}")
                return
            self._send(200, engine.answer(self.rfile.read(size)))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
