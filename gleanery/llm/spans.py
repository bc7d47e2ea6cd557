"""Labelled spans of a text, as ``array<struct<kind,start,end>>`` in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def arranged(spans: list[tuple[str, int, int]], kinds: Sequence[str]) -> list[dict]:
    """By start, then by the place of the kind in ``kinds``."""
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))]


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def replaced(text: str, spans: list[tuple[str, int, int]], mark=lambda kind: f"[{kind.upper()}]") -> str:
    """``text`` with every span replaced; of overlapping spans, the union is replaced by the mark of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])
