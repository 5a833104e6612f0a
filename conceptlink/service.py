"""Mapping and search for requests in plain dictionaries; an HTTP layer only has to pass them on."""

from __future__ import annotations

import json
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from .functions.embed import OFFLINE
from .plans.mapper import RETRIEVERS, ComponentCache, ConceptMapper
from .sources.config import ServiceConfig

CACHE = ComponentCache(20)


class BadRequest(ValueError):
    """What an HTTP layer answers with status 400."""


def checked_concepts(request: Mapping[str, Any]) -> list[dict]:
    items = request.get("source_concepts")
    if not items:
        raise BadRequest("at least one source concept is needed")
    if any(not isinstance(c, Mapping) or c.get("source_code_description") is None for c in items):
        raise BadRequest("every source concept needs a source_code_description")
    return [dict(c) for c in items]


def map_concepts(spark: SparkSession, root: str, request: Mapping[str, Any], config: ServiceConfig = ServiceConfig()) -> list[dict]:
    items = checked_concepts(request)
    key = tuple(request.get(f"{k}_id") for k in ("translator", "retriever", "reranker", "selector"))
    make = lambda: ConceptMapper(spark, key[1] or OFFLINE.name, key[0], key[2], key[3], root, rate_limit=config.rate_limit)
    rows = CACHE.get((root, *key), make).map(items).orderBy("query_id").drop("query_id").collect()
    return [r.asDict() for r in rows]


def search(spark: SparkSession, root: str, request: Mapping[str, Any], config: ServiceConfig = ServiceConfig()) -> list[dict]:
    """Candidates per query in rank order."""
    queries = request.get("queries")
    if not queries:
        raise BadRequest("at least one query is needed")
    name = request.get("retriever_id") or OFFLINE.name
    retriever = CACHE.get((root, name), lambda: RETRIEVERS.load(name, root=root, spark=spark))
    found = retriever(list(queries), request.get("where"), request.get("top_k", 10)).orderBy("query_id", "rank").collect()
    out = [{"query": q, "results": []} for q in queries]
    for r in found:
        out[r.query_id]["results"].append({k: v for k, v in r.asDict().items() if k not in ("query_id", "query")})
    return out


def stored_config(root: str) -> ServiceConfig:
    """The settings in service.json of a local root, or the defaults."""
    path = Path(root) / "service.json"
    return ServiceConfig.load(path) if path.is_file() else ServiceConfig()


def serve(spark: SparkSession, root: str, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server for POST /map and POST /search; the caller runs ``serve_forever``.

    Settings come from service.json in the root; host and port given here go before those.
    """
    config = stored_config(root)
    routes = {"/map": map_concepts, "/search": search}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            status, answer = 404, {"error": "no such path"}
            if self.path in routes:
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
                    status, answer = 200, routes[self.path](spark, root, body, config)
                except ValueError as wrong:
                    status, answer = 400, {"error": str(wrong)}
            data = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: Any) -> None:
            return

    return ThreadingHTTPServer((config.host if host is None else host, config.port if port is None else port), Handler)
