"""Help containers: named byte ranges in linked blocks; one entry is a ZIP of pages."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
END = 0x7FFFFFFF
NEWER = b"\xff" * 8
HEADER = 16
BLOCK_HEAD = 31  # CR LF, three numbers of eight hexadecimal digits with a space behind each, CR LF
DESCRIPTION_HEAD = struct.calcsize("QQi")
PAGES_ENTRY = "FileStorage"


def container_format(data: bytes) -> int:
    return 16 if data[:8] == NEWER else 15


def document(data: bytes, at: int) -> bytes:
    """The document that begins in the block at ``at``, put together from its chain of blocks."""
    out, size = bytearray(), None
    seen = set()
    while at != END:
        if at in seen:
            raise ValueError("block chain runs in a circle")
        seen.add(at)
        head = data[at : at + BLOCK_HEAD]
        total, length, after = (int(head[i : i + 8], 16) for i in (2, 11, 20))
        size = total if size is None else size
        out += data[at + BLOCK_HEAD : at + BLOCK_HEAD + length]
        at = after
    return bytes(out[:size])


def toc(data: bytes) -> list[tuple[int, int]]:
    """(description, data) offsets; shorter parts are free blocks."""
    parts = data.split(struct.pack("i", END))[:-1]
    return [struct.unpack("2i", p) for p in parts if len(p) == 8]


def entries(data: bytes) -> dict[str, int]:
    """Where each named entry's data begins."""
    if container_format(data) == 16:
        raise NotImplementedError("containers of the newer format are not read")
    out = {}
    for description, at in toc(document(data, HEADER)):
        name = document(data, description)[DESCRIPTION_HEAD:].decode("utf-16")
        out[name.partition("\0")[0]] = at
    return out


def entry(data: bytes, name: str) -> bytes:
    at = entries(data)
    if name not in at:
        raise KeyError(f"the container has no entry {name}")
    return document(data, at[name])


def pages_of(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(entry(data, PAGES_ENTRY)), metadata_encoding="utf-8") as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                rows = [(path, name, data, None) for name, data in pages_of(content)]
            except (NotImplementedError, KeyError, ValueError, struct.error, zipfile.BadZipFile) as e:
                rows = [(path, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["container", "path", "content", "error"])


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """``container, path, content, error`` of every file in every container under ``path``; a container that cannot be read
    is one row with its error. A container is read whole by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_read, "container string, path string, content binary, error string")
