"""Growing an index: new pages, pending vectors, and whether anything is to be done."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.operators import index as ix
from gleanery.operators.index import Index


def new_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    return docs.join(pages.select("filename"), "filename", "left_anti")


def append(index: Index, docs: DataFrame, *, size: int | None = None, overlap: int | None = None) -> Index:
    """The index with the pages of ``docs`` that it lacks; ids go on from the last. Links of old pages to new ones are found
    as well. Nothing new leaves it as it is."""
    fresh = storage.written(new_pages(docs.dropDuplicates(["filename"]), index.pages), "fresh")
    if not fresh.take(1):
        return index
    meta = {r["key"]: r["value"] for r in index.meta.collect()} if index.meta is not None else {}
    cut = {"size": size or int(meta.get("chunk_size", ix.chunking.SIZE)), "overlap": int(meta.get("chunk_overlap", ix.chunking.OVERLAP)) if overlap is None else overlap}
    last_page, last_chunk = index.pages.agg(F.max("id")).first()[0] or 0, index.chunks.agg(F.max("chunk_id")).first()[0] or 0
    pages, chunks = ix.with_ids(fresh, **cut)
    pages = pages.withColumn("id", F.col("id") + last_page)
    chunks = chunks.withColumns({"page_id": F.col("page_id") + last_page} | {c: F.col(c) + last_chunk for c in ("chunk_id", "prev_id", "next_id")})
    pages, chunks = storage.written(pages, "pages"), storage.written(chunks, "chunks")
    both = index.pages.unionByName(pages)
    scheme = meta.get("link_scheme", ix.metadata.LINK_SCHEME)
    back = ix.links(index.pages, pages, scheme)
    terms, words, sizes = ix.text_tables(chunks)
    return Index(
        both,
        index.chunks.unionByName(chunks),
        index.postings.unionByName(terms),
        ix.merged_dictionaries(index.dictionary, words),
        index.sizes.unionByName(sizes),
        index.links.unionByName(ix.links(pages, both, scheme)).unionByName(back),
        index.vectors,
        ix.meta_table(index.spark, meta | {"pages": both.count()}),
    )


def pending(index: Index) -> DataFrame:
    """Chunks that have no vector yet."""
    rows = index.chunks.select("chunk_id", "title", "body")
    return rows if index.vectors is None else rows.join(index.vectors.select("chunk_id"), "chunk_id", "left_anti")


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int):
    """A ``mapInPandas`` function: one client a task, texts in batches, vectors at length 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                v = np.asarray(embed((part["title"] + "\n" + part["body"]).tolist()), np.float64).reshape(len(part), -1)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, norm, out=v.copy(), where=norm > 0).astype(np.float32)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vec": list(v)})

    return run


def embed_pending(index: Index, root: str, make: Callable, *, batch: int = 64, super_batch: int = 100_000) -> int:
    """Embed what is pending, ``super_batch`` chunks a commit; what a crash leaves undone is pending at the next call.

    Commits append to one folder, ``root``; a commit that fails leaves none of its rows there.  What is pending is found
    once and written, so a commit reads its own chunks and nothing is joined again.
    """
    spark, done = index.spark, 0
    todo = pending(index)
    if storage.exists(spark, root):
        todo = todo.join(spark.read.parquet(root).select("chunk_id").distinct(), "chunk_id", "left_anti")
    with storage.scope():
        todo = storage.written(todo.withColumn("part", F.floor(F.col("chunk_id") / super_batch)), "pending")
        for r in todo.select("part").distinct().orderBy("part").collect():  # a row a commit
            rows = todo.where(F.col("part") == r["part"]).select("chunk_id", "title", "body")
            made = rows.mapInPandas(embedder(make, batch), "chunk_id long, vec array<float>")
            made.write.mode("append").parquet(root)
            done += 1
    return done


def up_to_date(meta: dict[str, str], wanted: dict[str, str], indexed_at: float | None = None, newest: float | None = None) -> bool:
    """Nothing to build: every wanted parameter is what the index was built with, and no source is newer than it."""
    if any(str(meta.get(k)) != str(v) for k, v in wanted.items()):
        return False
    return newest is None or indexed_at is None or newest <= indexed_at
