"""Intermediate tables in the folder that driver and executors share, joins whose broadcasts are size-checked, and joins by
keys of which some may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.storage import BROADCAST_ROWS, discard, fresh_path, scope, small
from gleanery.storage import written as cut

__all__ = ["BROADCAST_ROWS", "cut", "discard", "fresh_path", "scope", "small", "clash_free", "release", "schema_of", "column_at", "anti_join", "spread_join", "key_bits", "has_key"]

#: A key with more than the whole over this many rows is hot; so there are fewer such keys than this.
HOT_KEYS = 1000
#: Bits of a filter of keys, and the parts in which it is put together.
BITS, SEGMENTS = 1 << 26, 64


def clash_free(df: DataFrame, **columns) -> DataFrame:
    """``df`` with ``columns`` set; a column of the same name, in any case, is replaced."""
    taken = {c.lower() for c in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced, before the next large shuffle."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def column_at(df: DataFrame, name: str) -> int:
    """Where the column stands, found as Spark finds it: in any case if no other has that name."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    return (exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()])[0]


def anti_join(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` without the keys in ``gone`` (written first; broadcast only when few)."""
    gone = cut(gone.select(key).where(f"`{key}` is not null").distinct(), "gone", keep=True)
    return docs.join(small(gone), key, "left_anti").select(*docs.columns)


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``left`` with the columns of ``right``, null where its key is not there.

    ``right`` is a written table with a row a key, whose column ``weight`` says how many rows of ``left`` have the key, of
    ``total`` in all.  A small ``right`` is broadcast.  Of a large one the hot keys are, of which there are fewer than
    ``HOT_KEYS``, so that no task gets all rows of one; the others are shuffled."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    is_hot = F.col(weight).cast("double") * HOT_KEYS > total
    hot, rest = F.broadcast(right.where(is_hot)), right.where(~is_hot)
    others = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(others.join(rest, key, "left"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(BITS, bool)
    for batch in batches:
        keys = batch.column(0).drop_null().to_numpy().view(np.uint64)
        flags[(keys & np.uint64(BITS - 1)).astype(np.int64)] = True
    z = zstandard.ZstdCompressor(level=1)
    parts = [z.compress(np.packbits(x, bitorder="little").tobytes()) for x in np.split(flags, SEGMENTS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], names=["segment", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    d, z = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for segment, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.frombuffer(d.decompress(part), np.uint8)
            held[segment] = held[segment] | bits if segment in held else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([z.compress(b.tobytes()) for b in held.values()], pa.binary())], names=["segment", "bits"])


def key_bits(keys: DataFrame) -> np.ndarray:
    """A filter that every key of the one long column passes, and few others while there are fewer keys than ``BITS``.  Its
    size is the same whatever the input; with too many keys it passes all."""
    out = np.zeros(BITS // 8, np.uint8)
    d, size = zstandard.ZstdDecompressor(), BITS // 8 // SEGMENTS
    for r in keys.mapInArrow(_marked, "segment int, bits binary").repartition(SEGMENTS, "segment").mapInArrow(_united, "segment int, bits binary").collect():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(d.decompress(r["bits"]), np.uint8)
    return out


def has_key(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
