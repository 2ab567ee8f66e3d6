"""A small HTTP front for an engine and its stores.

    GET    /health                        {"status":"ok","stores":{...}}
    POST   /query?name=value              statement in the body, {"rows":[...]}
    POST   /stream?name=value             the same for a scan with filter, projection and LIMIT only
    GET    /scan?table=t&alias=a          qualified rows of a table
    GET    /lookup?table=t&alias=a&key=k  the qualified row of a key, if there is one
    GET, PUT, DELETE  /stores/<name>/entries/<key>    one record as a JSON object
    PUT, DELETE       /stores/<name>/entries          {"key": record, ...} or ["key", ...]
    POST   /stores/<name>/flush, /stores/<name>/compact

``authorize`` sees every request first.  Mistakes in a request are 400, other failures 500.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from .engine import Engine
from .functions.parameters import parse_parameter
from .sources.jsonrows import as_json, listed_json, rows_json
from .store import RecordStore

#: Characters of an answer that are put together before they are sent.
CHUNK_CHARS = 1 << 16

Authorizer = Callable[[BaseHTTPRequestHandler], bool]


class _Refused(Exception):
    def __init__(self, status: int, message: str, **headers: str):
        super().__init__(message)
        self.status, self.headers = status, headers


def serve(engine: Engine | None, stores: Mapping[str, RecordStore] | None = None, host: str = "127.0.0.1", port: int = 0, authorize: Authorizer = lambda request: True) -> ThreadingHTTPServer:
    """A server that is bound but not running: call ``serve_forever`` (in a thread)."""
    held = dict(stores or {})

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args: object) -> None:
            pass

        def answer(self, status: int, parts: Iterable[str] = (), headers: Mapping[str, str] | None = None) -> None:
            body = "".join(parts).encode()
            self.send_response(status)
            for name, value in (headers or {}).items():
                self.send_header(name, value)
            if body:
                self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Connection", "close")  # a request's body may not have been read
            self.end_headers()
            self.wfile.write(body)

        def answer_rows(self, parts: Iterable[str]) -> None:
            """Parts go out in chunks as they come; the first one is made before the status is sent.

            A failure after that closes the connection without the last chunk, so that the
            client sees that the answer isn't whole.
            """
            parts = iter(parts)
            waiting, size = [next(parts, "")], 0
            waiting.append(next(parts, ""))
            chunked = self.request_version >= "HTTP/1.1"
            self.send_response(200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Connection", "close")
            if chunked:
                self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()

            def send() -> None:
                data = "".join(waiting).encode()
                waiting.clear()
                if data:
                    self.wfile.write(b"%x\r\n%b\r\n" % (len(data), data) if chunked else data)

            try:
                for part in parts:
                    waiting.append(part)
                    size += len(part)
                    if size >= CHUNK_CHARS:
                        send()
                        size = 0
                send()
                if chunked:
                    self.wfile.write(b"0\r\n\r\n")
            except Exception as e:  # noqa: BLE001  (the status is out: all that's left is to end early)
                self.log_error("Answer broken off: %s", e)

        def error(self, status: int, message: str, headers: Mapping[str, str] | None = None) -> None:
            self.answer(status, [as_json({"error": message})], headers)

        def body(self) -> str:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()

        def allow(self, *methods: str) -> None:
            if self.command not in methods:
                raise _Refused(405, "Method not allowed", Allow=", ".join(methods))

        def handle_request(self) -> None:
            try:
                if not authorize(self):
                    raise _Refused(401, "Unauthorized", **{"WWW-Authenticate": "Bearer"})
                self.route()
            except _Refused as e:
                self.error(e.status, str(e), e.headers)
            except ValueError as e:
                self.error(400, str(e))
            except Exception as e:  # noqa: BLE001
                self.error(500, str(e) or type(e).__name__)

        do_GET = do_PUT = do_POST = do_DELETE = handle_request

        def route(self) -> None:
            url = urlsplit(self.path)
            parameters = {k: parse_parameter(v) for k, v in parse_qsl(url.query, keep_blank_values=True)}
            parts = [unquote(p) for p in url.path.strip("/").split("/")]
            if parts == ["health"]:
                self.allow("GET")
                self.answer(200, [as_json({"status": "ok", "stores": {n: s.size() for n, s in held.items()}})])
            elif parts[0] in ("query", "stream", "scan", "lookup") and len(parts) == 1:
                self.read(parts[0], parameters)
            elif parts[0] == "stores" and len(parts) in (3, 4) and parts[1] in held:
                self.records(held[parts[1]], parts[2:])
            else:
                raise _Refused(404, "Not found")

        def read(self, what: str, parameters: dict[str, object]) -> None:
            self.allow("POST" if what in ("query", "stream") else "GET")
            if engine is None:
                raise ValueError("No engine is configured")
            if what == "query":
                self.answer_rows(rows_json(engine.query(self.body(), parameters)))
                return
            if what == "stream":
                self.answer_rows(listed_json(engine.stream(self.body(), parameters)))
                return
            for name in ("table", "alias", "key")[: 2 + (what == "lookup")]:
                if name not in parameters:
                    raise ValueError(f"Missing parameter: {name}")
            table, alias = str(parameters["table"]), str(parameters["alias"])
            if what == "scan":
                self.answer_rows(rows_json(engine.scan(table, alias)))
                return
            row = engine.lookup(table, alias, parameters["key"])
            self.answer(200, [as_json({"rows": [] if row is None else [row]})])

        def records(self, store: RecordStore, parts: list[str]) -> None:
            if parts[0] == "entries" and len(parts) == 2:
                self.allow("GET", "PUT", "DELETE")
                self.record(store, parts[1])
            elif parts == ["entries"]:
                self.allow("PUT", "DELETE")
                given = json.loads(self.body())
                if self.command == "PUT":
                    store.put_all(store.frame(given))
                else:
                    store.remove_all(store.key_frame(given))
                self.answer(204)
            elif parts in (["flush"], ["compact"]):
                self.allow("POST")
                getattr(store, parts[0])()
                self.answer(204)
            else:
                raise _Refused(404, "Not found")

        def record(self, store: RecordStore, key: str) -> None:
            if self.command == "PUT":
                store.put_all(store.frame({key: json.loads(self.body())}))
                self.answer(204)
                return
            found = store.get(key) if self.command == "GET" else store.remove(key)
            if found is None:
                raise _Refused(404, "Entry not found")
            if self.command == "GET":
                self.answer(200, [as_json(found)])
            else:
                self.answer(204)

    return ThreadingHTTPServer((host, port), Handler)
