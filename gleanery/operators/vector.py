"""Exact cosine search: a block of queries is held against all vectors, best rows first in each task, then over all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.operators.index import Index

#: Numbers in a block of query vectors (64 MB of them): a pass over the vectors answers a whole block.
BLOCK_NUMBERS = 1 << 23
#: Queries that are multiplied with a batch of vectors at a time.
ROWS_AT_ONCE = 1024


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _best(queries, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        best_id = np.zeros((len(ids), 0), np.int64)
        best = np.zeros((len(ids), 0))
        for batch in batches:
            ok = batch.filter(batch.column(1).is_valid())
            if not ok.num_rows:
                continue
            m, chunk = _matrix(ok.column(1)), ok.column(0).to_numpy(zero_copy_only=False)
            n = min(top, best.shape[1] + len(chunk))
            better, better_id = np.empty((len(ids), n)), np.empty((len(ids), n), np.int64)
            for a in range(0, len(ids), ROWS_AT_ONCE):
                b = min(a + ROWS_AT_ONCE, len(ids))
                score = np.concatenate([best[a:b], q[a:b] @ m.T], axis=1)
                keys = np.concatenate([best_id[a:b], np.broadcast_to(chunk, (b - a, len(chunk)))], axis=1)
                order = np.lexsort((keys, -score), axis=1)[:, :n]
                better[a:b], better_id[a:b] = np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)
            best, best_id = better, better_id
        n = best.shape[1]
        for a in range(0, len(ids), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a:b], n)), pa.array(best_id[a:b].ravel()), pa.array(best[a:b].ravel())], names=["query_id", "chunk_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score, pos``: the ``k`` best of (chunk_id, vec) rows for each (query_id, vec) row, ties to the
    lesser chunk. Queries go out in blocks of ``BLOCK_NUMBERS``; what is shuffled is k rows a query and task."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col("chunk_id").cast("long"), "vec")
    found = spark.createDataFrame([], "query_id long, chunk_id long, score double")
    asked = queries.select("query_id", "vec").where("vec is not null").toLocalIterator()
    block: list = []

    def flush():
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in block], np.int64), np.array([r["vec"] for r in block], np.float64)))
        block.clear()
        return found.unionByName(narrow.mapInArrow(_best(shared, k), "query_id long, chunk_id long, score double"))

    for row in asked:  # the driver holds a block at a time
        block.append(row)
        if len(block) * max(1, len(row["vec"])) >= BLOCK_NUMBERS:
            found = flush()
    if block:
        found = flush()
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("pos", pos).where(F.col("pos") <= k)


def search(index: Index, queries: DataFrame, *, limit: int = 10, per_page: int = 2, section: str | None = None, kind: str | None = None) -> DataFrame:
    """Results like those of the full-text search for (query_id, vec) rows of unit vectors; filters come before the cut.
    ``per_page`` 0 is no limit. Without vectors, or with none left by the filters, there are no rows."""
    heads = index.chunks.select("chunk_id", F.col("filename").alias("id"), "title", F.col("title").alias("snippet"), "source_path", "section", "kind", "chunk_index", "total_chunks", F.col("title").alias("chunk_title"))
    heads = heads.where(F.col("section") == section) if section else heads
    heads = heads.where(F.col("kind") == kind) if kind else heads
    vectors = index.vectors.join(heads.select("chunk_id"), "chunk_id", "left_semi") if section or kind else index.vectors
    found = heads.join(storage.small(storage.written(top_k(vectors, queries, 4 * limit), "top")), "chunk_id")
    if per_page > 0:
        found = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))).where(f"__n <= {per_page}").drop("__n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "id", "title", "snippet", "source_path", "section", "kind", "score", "chunk_id", "chunk_index", "total_chunks", "chunk_title")
