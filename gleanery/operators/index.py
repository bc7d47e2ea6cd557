"""Index tables from pages: pages, chunks, postings, statistics, links."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.functions import chunking, metadata, text

#: Columns a term may stand in, and their codes in the postings.
COLUMNS = {"title": 0, "description": 1, "body": 2}


def dense_ids(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``name``: 1..N in the order of ``order``, without bringing all rows to one task: rows are sorted across partitions,
    and each partition's first number follows from the sizes of those before it (one row a partition)."""
    placed = storage.written(df.orderBy(order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("__part", part).join(F.broadcast(first), "__part").withColumn(name, number.cast("long")).drop("__part", "__at", "__before")


def pages_from(docs: DataFrame) -> DataFrame:
    """Page columns of (filename, text[, source_path]) rows; file names are stems."""
    name = F.concat("filename", F.lit(".md"))
    return docs.select(
        "filename",
        metadata.title(F.col("text"), name).alias("title"),
        metadata.section(F.col("filename")).alias("section"),
        metadata.kind(name).alias("kind"),
        metadata.source(F.col("filename")).alias("book"),
        (F.col("source_path") if "source_path" in docs.columns else name).alias("source_path"),
        F.coalesce(F.col("text"), F.lit("")).alias("body"),
        metadata.description(F.coalesce(F.col("text"), F.lit(""))).alias("description"),
    )


def chunk_table(pages: DataFrame, *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """A row a chunk, with what its page says: page ids are joined on, so only ids and chunks are made by Python."""
    cut = chunking.chunks(pages.select(F.col("id").alias("page_id"), "body"), size=size, overlap=overlap)
    head = pages.select(F.col("id").alias("page_id"), "filename", "title", "description", "section", "kind", "source_path")
    return cut.join(head, "page_id").withColumn("chars", F.length("body")).withColumn("src", F.when(F.col("total_chunks") == 1, "page").otherwise("chunk"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """``prev_id`` and ``next_id`` within the page."""
    w = Window.partitionBy("page_id").orderBy("chunk_index")
    return chunks.withColumns({"prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a chunk's id and the terms of each of its columns: a row for each distinct term of a column, with its
    places in order; ``first`` marks one of a term's rows in a chunk."""
    for batch in batches:
        lists = batch.columns[1:]
        flat = pa.concat_arrays([x.flatten() for x in lists])
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        row = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]).astype(np.int64)
        col = np.repeat(np.fromiter(COLUMNS.values(), np.int8), [len(x.flatten()) for x in lists])
        sizes = [pc.list_value_length(x).to_numpy() for x in lists]
        place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
        term = row * len(coded.dictionary) + coded.indices.to_numpy()
        key = term * len(COLUMNS) + col
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        ends, head = np.append(start, len(order)), order[start]
        first = np.concatenate([[True], np.diff(term[head]) > 0])
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(coded.indices.take(pa.array(head))), batch.column(0).take(pa.array(row[head])), pa.array(col[head]), pa.array(np.diff(ends), pa.int32()), pa.array(first), places],
            names=["term", "chunk_id", "col", "n", "first", "places"],
        )


def postings(chunks: DataFrame) -> DataFrame:
    """A row for every distinct term of a chunk's column: term, chunk_id, col, how often, whether it is the first of the
    term's rows in the chunk, and where it stands.  Terms are parted by JVM functions and gathered within their chunk, so
    nothing is shuffled."""
    terms = [text.index_terms(F.col(name)).alias(name) for name in COLUMNS]
    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), *terms).mapInArrow(_grouped, "term string, chunk_id long, col tinyint, n int, first boolean, places array<int>")


def dictionary(postings: DataFrame) -> DataFrame:
    """``term, df``: in how many chunks a term stands, in whichever column."""
    return postings.where("first").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def merged_dictionaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """The dictionary of two sets of chunks that have no chunk in common."""
    return old.unionByName(new).groupBy("term").agg(F.sum("df").alias("df"))


def chunk_sizes(postings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Terms of all columns of each chunk, 0 for a chunk without any."""
    n = postings.groupBy("chunk_id").agg(F.sum("n").alias("n_terms"))
    return chunks.select("chunk_id").join(n, "chunk_id", "left").select("chunk_id", F.coalesce("n_terms", F.lit(0)).cast("int").alias("n_terms"))


def links(pages: DataFrame, known: DataFrame | None = None, scheme: str = metadata.LINK_SCHEME) -> DataFrame:
    """(src, dst) of every Markdown link to another known page, with repeats; ``scheme`` is that of links between books."""
    known = pages if known is None else known
    out = pages.select(F.col("filename").alias("src"), F.explode(metadata.link_targets(F.col("body"))).alias("t"))
    out = out.select("src", metadata.normal_target(F.col("t"), scheme).alias("dst")).where("dst is not null and dst <> src")
    return out.join(known.select(F.col("filename").alias("dst")), "dst", "left_semi").select("src", "dst")


@dataclass
class Index:
    pages: DataFrame
    chunks: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    sizes: DataFrame
    links: DataFrame
    vectors: DataFrame | None = None
    meta: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.pages.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}

    def publish(self, root: str) -> str:
        """Postings are sorted by term across files (hot terms split by chunk), so a query reads only its terms' row groups."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        by_term = self.postings.repartitionByRange(parts, "term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        return storage.publish(self.spark, root, self.tables() | {"postings": by_term})

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Index:
        version = storage.current_version(spark, root)
        if version is None:
            raise FileNotFoundError(f"no index was published in {root}")
        at = {f.name: f"{root}/{version}/{f.name}" for f in fields(cls)}
        return cls(**{name: spark.read.parquet(p) for name, p in at.items() if storage.exists(spark, p)})

    def corpus(self) -> tuple[int, float]:
        """Chunks, and terms of an average chunk; counted once for an index in memory."""
        if "_corpus" not in self.__dict__:
            n, mean = self.sizes.agg(F.count(F.lit(1)), F.avg("n_terms")).first()
            self._corpus = (n, mean or 0.0)
        return self._corpus

    def stats(self) -> dict:
        counts = {name: (getattr(self, name).count() if getattr(self, name) is not None else 0) for name in ("pages", "links", "chunks", "vectors")}
        return counts | {"meta": {r["key"]: r["value"] for r in self.meta.collect()} if self.meta is not None else {}}


def meta_table(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "key string, value string")


def with_ids(docs: DataFrame, *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Pages numbered by the order of their names with extension, and chunks numbered by page and place."""
    with storage.scope():
        pages = dense_ids(pages_from(docs), F.concat("filename", F.lit(".md")), "id")
        pages = storage.written(pages.select("id", *[c for c in pages.columns if c != "id"]), "pages", keep=True)
        chunks = dense_ids(chunk_table(pages, size=size, overlap=overlap), F.struct("page_id", "chunk_index"), "chunk_id")
        return pages, storage.written(neighbours(chunks), "chunks", keep=True)


def build(docs: DataFrame, *, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP, params: dict[str, str] | None = None, scheme: str = metadata.LINK_SCHEME) -> Index:
    """All tables of an index of (filename, text) rows. File names must be distinct."""
    pages, chunks = with_ids(docs, size=size, overlap=overlap)
    meta = {"indexed_at": int(time.time()), "chunk_size": size, "chunk_overlap": overlap, "link_scheme": scheme, "pages": pages.count()} | (params or {})
    return Index(pages, chunks, *text_tables(chunks), storage.written(links(pages, scheme=scheme), "links"), None, meta_table(docs.sparkSession, meta))


def text_tables(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, dictionary and sizes of chunks."""
    terms = storage.written(postings(chunks), "postings")
    return terms, storage.written(dictionary(terms), "dictionary"), storage.written(chunk_sizes(terms, chunks), "sizes")


def rebuild_text(index: Index, root: str) -> str:
    """Publish the index anew with its full-text tables made again from its chunks; pages, links and vectors stay."""
    terms, words, sizes = text_tables(index.chunks)
    return replace(index, postings=terms, dictionary=words, sizes=sizes).publish(root)
