"""A read-only endpoint: GET /database/expression gives the expression's value as JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.errors import PySparkException

from ..errors import RelError
from . import json_text


def server(evaluate: dict[str, Callable], port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of databases, each with what evaluates a text in it (such as ``Session.evaluate``); run its serve_forever().

    An unknown database is 404, an expression that fails is 400 with the error's name.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name, _, expression = unquote(self.path.partition("?")[0]).lstrip("/").partition("/")
            if name not in evaluate or not expression:
                self.answer(404, json.dumps({"error": "not_found_error"}))
                return
            try:
                self.answer(200, json_text(evaluate[name](expression)))
            except (RelError, PySparkException) as e:
                self.answer(400, json.dumps({"error": getattr(e, "name", "system_error"), "msg": str(e)}))

        def answer(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
