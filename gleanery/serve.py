"""The engine's tools as a JSON-RPC service (Model Context Protocol), over standard streams or HTTP."""

from __future__ import annotations

import inspect
import json
import sys
import typing
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from gleanery.service import Engine

NAME, VERSION = "gleanery", "0.2.0"
#: Version of the protocol that is spoken where the client names none.
PROTOCOL = "2024-11-05"
TOOLS = {
    "search": "Ranked search of the index: words, vectors or both, as the settings say.",
    "get_page": "A page by file name or number, one of its chunks, or several pages within max_chars.",
    "hierarchy": "Sections with their numbers of pages, or the groups of one section.",
    "related": "Pages that a page links to, and pages that link to it.",
    "build": "Build the index in the background; answers with a job's id.",
    "build_status": "How far a build is.",
    "discover": "Settings, installations and the state of the index.",
    "config_get": "The settings.",
    "config_set": "Change settings and save them.",
}
_KINDS = {str: "string", int: "integer", bool: "boolean", dict: "object", list: "array", float: "number"}


def schema(call) -> dict:
    """What a tool takes, from its signature."""
    hints, properties, required = typing.get_type_hints(call), {}, []
    for name, p in inspect.signature(call).parameters.items():
        if p.kind is p.VAR_KEYWORD:
            continue
        kinds = [t for t in typing.get_args(hints[name]) or (hints[name],) if t is not type(None)]
        kinds = [_KINDS.get(typing.get_origin(t) or t, "string") for t in kinds] if typing.get_origin(hints[name]) is not list else ["array"]
        properties[name] = {"type": kinds[0] if len(kinds) == 1 else kinds}
        if p.default is p.empty:
            required.append(name)
    return {"type": "object", "properties": properties, "required": required}


class Tools:
    """The nine tools, with defaults that suit a remote caller."""

    def __init__(self, engine: Engine, config_path: str | None = None):
        self.engine, self.config_path = engine, config_path

    def search(self, query: str, section: str | None = None, kind: str | None = None, limit: int | None = None) -> dict:
        return self.engine.search(query, section, kind, limit)

    def get_page(self, id: str | list, chunk: int | None = None, max_chars: int | None = None) -> dict:
        return self.engine.get_page(id, chunk, **({"max_chars": max_chars} if max_chars else {}))

    def hierarchy(self, section: str | None = None) -> dict:
        return self.engine.hierarchy(section)

    def related(self, id: str) -> dict:
        return self.engine.related(id)

    def build(self, sources: list | None = None, lang: str | None = None, cleanup: bool | None = None, force: bool | None = None, chunk_size: int | None = None, chunk_overlap: int | None = None) -> dict:
        own = {"cleanup": cleanup, "chunk_size": chunk_size, "chunk_overlap": chunk_overlap}
        return self.engine.build(force=bool(force), sources=sources, lang=lang, **{k: v for k, v in own.items() if v is not None})

    def build_status(self, job_id: str) -> dict:
        return self.engine.build_status(job_id)

    def discover(self) -> dict:
        return self.engine.discover()

    def config_get(self) -> dict:
        return self.engine.config_get()

    def config_set(self, values: dict) -> dict:
        nested: dict = {}
        for key, value in values.items():  # a.b.c or nested tables
            *path, last = key.split(".")
            at = nested
            for p in path:
                at = at.setdefault(p, {})
            at[last] = value
        return self.engine.config_set(nested, self.config_path)


class Protocol:
    def __init__(self, tools: Tools):
        self.tools = tools

    def answer(self, message: dict) -> dict | None:
        """The reply to one message; none to a notification."""
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        method, asked = message.get("method"), message.get("params") or {}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": asked.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": VERSION}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": schema(getattr(self.tools, n))} for n, d in TOOLS.items()]}}
        if method == "tools/call":
            return reply | {"result": self.called(asked.get("name"), asked.get("arguments") or {})}
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}

    def called(self, name: str, arguments: dict) -> dict:
        try:
            if name not in TOOLS:
                raise LookupError(f"no tool {name}")
            said, failed = json.dumps(getattr(self.tools, name)(**arguments), ensure_ascii=False, default=str), False
        except Exception as e:  # the caller is told; the service goes on
            said, failed = f"{type(e).__name__}: {e}", True
        return {"content": [{"type": "text", "text": said}], "isError": failed}

    def text(self, line: str) -> str | None:
        try:
            message = json.loads(line)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}})
        if isinstance(message, list):
            replies = [r for m in message if (r := self.answer(m))]
            return json.dumps(replies, ensure_ascii=False) if replies else None
        reply = self.answer(message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "no request"}}
        return json.dumps(reply, ensure_ascii=False) if reply else None


def over_streams(protocol: Protocol, source=None, sink=None) -> None:
    """A message a line, until the source ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if line.strip() and (reply := protocol.text(line)):
            sink.write(reply + "\n")
            sink.flush()


def over_http(protocol: Protocol, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server whose every POST is a message; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            reply = protocol.text(self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace"))
            data = (reply or "").encode()
            self.send_response(200 if reply else 202)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
