"""HTTP surface of a store on the standard library: one driver process, requests one at a time."""

from __future__ import annotations

import html
import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

from pyspark.sql import functions as F

from .functions import scalars
from .sources.store import Store


def lookup(store: Store, key: str) -> dict:
    """found, key, value, value_hex of a key."""
    v = F.col("value").cast("binary")
    row = store.get(key).select(scalars.lossy_text(v).alias("value"), scalars.spaced_hex(v).alias("value_hex")).first()
    return {"found": row is not None, "key": key, "value": row and row.value, "value_hex": row and row.value_hex}


def report(store: Store) -> str:
    """A static page of health, counters and levels."""
    health = store.health()
    up = store.spark.range(1).select(scalars.uptime(F.lit(health["uptime_seconds"])).alias("u")).first().u
    tables = "".join(
        f"<h2>{title}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in frame.columns)}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in frame.collect()) + "</table>"
        for title, frame in (("Operations", store.metrics()), ("Levels", store.stats()))
    )
    return f"<!DOCTYPE html><html><head><title>keystrata</title></head><body><h1>{html.escape(store.path)}</h1><p>{health['status']}, generation {health['generation']}, up {up}</p>{tables}</body></html>"


def respond(store: Store, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
    """(status, content type, body) of a request."""
    as_json = lambda status, x: (status, "application/json", json.dumps(x, default=str).encode())
    rows = lambda frame: [r.asDict() for r in frame.collect()]
    if method == "GET" and path == "/":
        return 200, "text/html; charset=utf-8", report(store).encode()
    if method == "GET" and path == "/api/health":
        return as_json(200, store.health())
    if method == "GET" and path == "/api/metrics":
        return as_json(200, rows(store.metrics())[0])
    if method == "GET" and path == "/api/stats":
        return as_json(200, {"levels": rows(store.stats())})
    if method == "GET" and path.startswith("/api/get/"):
        return as_json(200, lookup(store, unquote(path[len("/api/get/") :])))
    if method == "POST" and path == "/api/put":
        try:
            sent = json.loads(body)
            key, value = sent["key"], sent["value"]
        except (ValueError, KeyError, TypeError):
            return as_json(400, {"error": "a JSON object with key and value is needed"})
        return as_json(200, {"ok": True, "snapshot": store.put(key, value)})
    if method == "POST" and path.startswith("/api/delete/"):
        return as_json(200, {"ok": True, "snapshot": store.delete(unquote(path[len("/api/delete/") :]))})
    if method == "POST" and path == "/api/compact":
        return as_json(200, {"ok": True, "merges": store.compact(force=True)})
    return as_json(404, {"error": "no such route"})


def make_server(store: Store, host: str = "127.0.0.1", port: int = 8080) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            sent = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, body = respond(store, self.command, self.path, sent)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return HTTPServer((host, port), Handler)


def serve(store: Store, host: str = "127.0.0.1", port: int = 8080) -> None:
    make_server(store, host, port).serve_forever()
