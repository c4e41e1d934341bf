"""A thin JSON front end over an ``Engine``, for one driver and interactive use.

    GET    /api/indexes                            names
    POST   /api/index/create?name=N[&id=FIELD]     body: an array of records
    DELETE /api/index/N
    GET    /api/index/N/data                       page, size, field, operator, value
    POST   /api/index/N/document                   body: a record
    GET, PUT, DELETE /api/index/N/document/K       the k-th document in id order
    GET    /api/search/N                           q, page, size, search_type, fuzzy_threshold, sort, order
    GET    /api/metrics
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import Any
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame

from textmill.operators import features, filters
from textmill.plans.engine import Engine, Request
from textmill.sources import ingest


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Api:
    """Routes without a socket: ``handle`` gives (status, body)."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.lock = engine, Lock()

    def handle(self, method: str, target: str, body: str = "") -> tuple[int, Any]:
        url = urlsplit(target)
        parts = [unquote(p) for p in url.path.strip("/").split("/")]
        try:
            with self.lock:
                return 200, self._route(method, parts, dict(parse_qsl(url.query)), body)
        except (KeyError, IndexError) as e:
            return 404, {"error": str(e)}
        except (ValueError, TypeError) as e:
            return 400, {"error": str(e)}

    def _route(self, method: str, parts: list[str], args: dict[str, str], body: str) -> Any:
        engine = self.engine
        match (method, parts):
            case ("GET", ["api", "indexes"]):
                return {"indexes": engine.names()}
            case ("GET", ["api", "metrics"]):
                return {"metrics": _rows(engine.metrics())}
            case ("POST", ["api", "index", "create"]):
                engine.create(args["name"], body or "[]", args.get("id"))
                return {"created": args["name"]}
            case ("DELETE", ["api", "index", name]):
                engine.drop(name)
                return {"deleted": name}
            case ("GET", ["api", "index", name, "data"]):
                corpus = engine.get(name).corpus
                condition = filters.ui_filter(corpus.schema, args.get("field", ""), args.get("operator", "contains"), args["value"]) if args.get("value") else None
                page, size = int(args.get("page", 1)), int(args.get("size", 20))
                total = (corpus if condition is None else corpus.where(condition)).count()
                return {"items": _rows(features.listing(corpus, page, size, condition)), "total": total, "page": page, "size": size}
            case ("POST", ["api", "index", name, "document"]):
                engine.replace(name, engine.get(name).upsert(self._record(name, body)))
                return {"added": True}
            case ("GET", ["api", "index", name, "document", k]):
                index = engine.get(name)
                return _rows(index.document(index.id_at(int(k))))[0]
            case ("PUT", ["api", "index", name, "document", k]):
                engine.replace(name, engine.get(name).update_at(int(k), self._record(name, body)))
                return {"updated": int(k)}
            case ("DELETE", ["api", "index", name, "document", k]):
                engine.replace(name, engine.get(name).delete_at(int(k)))
                return {"deleted": int(k)}
            case ("GET", ["api", "search", name]):
                request = Request(
                    args.get("q", ""),
                    search_type=args.get("search_type", "fuzzy"),
                    fuzzy_threshold=int(args.get("fuzzy_threshold", 2)),
                    sort_field=args.get("sort", ""),
                    sort_order=args.get("order", "asc"),
                    page=int(args.get("page", 1)),
                    size=int(args.get("size", 10)),
                )
                found = engine.search(name, request)
                return {"items": _rows(found.items), "total": found.total, "page": found.page, "total_pages": found.total_pages}
        raise KeyError(f"no route {method} /{'/'.join(parts)}")

    def _record(self, name: str, body: str) -> DataFrame:
        record = json.loads(body)
        if not isinstance(record, dict):
            raise ValueError("a record is a JSON object")
        kinds = {f.name: f.dataType for f in self.engine.get(name).corpus.schema.fields}
        made = ingest.from_records(self.engine.spark, [record], "id" if "id" in record else None)
        return made.select(*[made[c].cast(kinds[c]).alias(c) if c in kinds else made[c] for c in made.columns])


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``; requests are answered one at a time."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = api.handle(self.command, self.path, self.rfile.read(size).decode())
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
