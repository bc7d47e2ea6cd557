"""Command line: search, build, add-source, get-page, hierarchy, related, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from gleanery import serve
from gleanery.config import Config
from gleanery.service import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery")
    p.add_argument("--config")
    p.add_argument("--version", action="version", version=f"{serve.NAME} {serve.VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--section")
    s.add_argument("--kind")
    s.add_argument("--limit", type=int)
    b = sub.add_parser("build")
    b.add_argument("--sources", nargs="+")
    b.add_argument("--lang")
    b.add_argument("--force", action="store_true")
    b.add_argument("--cleanup", action="store_true", default=None)
    b.add_argument("--chunk-size", type=int)
    b.add_argument("--chunk-overlap", type=int)
    g = sub.add_parser("get-page")
    g.add_argument("id")
    g.add_argument("--chunk", type=int)
    sub.add_parser("hierarchy").add_argument("--section")
    sub.add_parser("related").add_argument("id")
    n = sub.add_parser("add-source")
    n.add_argument("id")
    n.add_argument("--no-embed", action="store_true")
    v = sub.add_parser("serve")
    v.add_argument("--http", action="store_true")
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    engine = Engine(SparkSession.builder.appName("gleanery").getOrCreate(), Config.found(a.config))
    if a.command == "serve":
        protocol = serve.Protocol(serve.Tools(engine, a.config))
        serve.over_http(protocol, a.host, a.port).serve_forever() if a.http else serve.over_streams(protocol)
        return 0
    try:
        if a.command == "search":
            out = engine.search(a.query, a.section, a.kind, a.limit)
        elif a.command == "build":
            out = engine.build_now(force=a.force, sources=a.sources, lang=a.lang, **{k: v for k in ("cleanup", "chunk_size", "chunk_overlap") if (v := getattr(a, k)) is not None})
        elif a.command == "get-page":
            out = engine.get_page(a.id, a.chunk)
        elif a.command == "add-source":
            out = engine.add_source(a.id, embed=not a.no_embed)
        elif a.command == "hierarchy":
            out = engine.hierarchy(a.section)
        else:
            out = engine.related(a.id)
    except (LookupError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
