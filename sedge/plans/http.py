"""The service over HTTP (API-1..4, SNK-9): three routes under one prefix, on the standard library's server.

`dispatch` is the router and needs no socket; `serve` binds it. Spark runs the jobs of several requests side by side.
"""

from __future__ import annotations

import datetime as dt
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import Row, SparkSession

from ..config import Settings
from ..errors import AskError, IndexingError, RequestError, SedgeError
from ..operators import generators
from . import service
from .store import Store

PREFIX = "/api/v1"
#: A request's body has at most so many bytes.
BODY = 1 << 20


class Api:
    def __init__(self, spark: SparkSession, store: Store, settings: Settings | None = None, generator: generators.Generator | None = None):
        self.spark, self.store, self.settings, self.generator = spark, store, settings, generator
        self.routes = {("GET", "/health"): self.health, ("POST", "/repository"): self.repository, ("POST", "/ask"): self.ask}

    def health(self, body: dict) -> tuple[int, dict]:
        return 200, service.health(self.settings)

    def repository(self, body: dict) -> tuple[int, dict]:
        return 201, service.index_repository(self.spark, self.store, _text(body, "repo_url"))

    def ask(self, body: dict) -> tuple[int, dict]:
        return 200, service.ask(self.spark, self.store, _text(body, "repository_id"), _text(body, "question"), self.generator)

    def dispatch(self, method: str, path: str, raw: bytes = b"") -> tuple[int, bytes]:
        """Status and JSON: 422 for a malformed request, 400 for what the service can't do, 404 and 405 for unknown routes."""
        route = path.partition("?")[0].removeprefix(PREFIX) if path.startswith(PREFIX) else ""
        handler = self.routes.get((method, route))
        if handler is None:
            known = any(r == route for _, r in self.routes)
            return (405, to_json({"detail": "Method Not Allowed"})) if known else (404, to_json({"detail": "Not Found"}))
        try:
            body = json.loads(raw) if raw else {}
            if not isinstance(body, dict):
                raise RequestError("The body must be a JSON object.")
            status, told = handler(body)
        except (RequestError, json.JSONDecodeError, UnicodeDecodeError) as e:
            return 422, to_json({"detail": str(e)})
        except (AskError, IndexingError, SedgeError) as e:
            return 400, to_json({"detail": str(e)})
        return status, to_json(told)


def _text(body: dict, name: str) -> str:
    value = body.get(name)
    if not isinstance(value, str):
        raise RequestError(f"{name} must be a string.")
    return value


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return value.asDict(recursive=True)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    raise TypeError(type(value).__name__)


def _rows(value: Any) -> Any:
    """Rows are tuples, which JSON would take for lists; they become objects first."""
    if isinstance(value, Row):
        return _rows(value.asDict())
    if isinstance(value, dict):
        return {k: _rows(v) for k, v in value.items()}
    return [_rows(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_json(value: Any) -> bytes:
    return json.dumps(_rows(value), default=_plain).encode()


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not running yet: call serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = (413, to_json({"detail": "The body is too long."})) if size > BODY else api.dispatch(self.command, self.path, self.rfile.read(size))
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, form: str, *args: object) -> None:
            service.log.info(form, *args)

    return ThreadingHTTPServer((host, port), Handler)
