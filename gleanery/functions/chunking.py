"""Cutting a text into overlapping chunks of whole lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 200


def line_pieces(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges that cover a line longer than ``size``, laid from its end so that only the first is short."""
    step = max(size - overlap, 1)
    whole = -(-(length - size) // step)
    first = length - size - whole * step
    return [(max(0, a), a + size) for a in range(first, length - size + 1, step)]


def chunk_ranges(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Code point ranges of the chunks of ``text``.

    Lines are gathered while they fit (each counts its line end); the next chunk starts again with as many of the last
    lines as fit in ``overlap``, one at least unless it is 0.  A line that is too long on its own is cut in pieces.
    """
    if len(text) <= size:
        return [(0, len(text))]
    at = [0]  # where each line starts
    for line in text.split("\n"):
        at.append(at[-1] + len(line) + 1)
    out: list[tuple[int, int]] = []
    first = 0
    for i in range(len(at) - 1):
        length = at[i + 1] - at[i] - 1
        if length > size:
            if first < i:
                out.append((at[first], at[i] - 1))
            out += [(at[i] + a, at[i] + b) for a, b in line_pieces(length, size, overlap)]
            first = i + 1
        elif first < i and at[i + 1] - at[first] > size:
            out.append((at[first], at[i] - 1))
            back = i
            while back > first and (at[i] - at[back - 1] <= overlap or (back == i and overlap > 0)):
                back -= 1
            first = back
    if first < len(at) - 1:
        out.append((at[first], len(text)))
    return out


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return [text[a:b] for a, b in chunk_ranges(text, size, overlap)]


def _chunker(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, body, total = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = chunk_text(text or "", size, overlap)
                rows += [i] * len(parts)
                index += range(len(parts))
                body += parts
                total += [len(parts)] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array(body, pa.string()), pa.array(total, pa.int32())], names=["page_id", "chunk_index", "body", "total_chunks"]
            )

    return run


def chunks(pages: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``page_id, chunk_index, body, total_chunks`` of (page_id, body) rows; a null body is one empty chunk. No shuffle."""
    narrow = pages.select("page_id", F.col("body").cast("string"))
    return narrow.mapInArrow(_chunker(size, overlap), f"page_id {narrow.schema['page_id'].dataType.simpleString()}, chunk_index int, body string, total_chunks int")
