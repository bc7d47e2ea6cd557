"""Pages, groups of pages, and their neighbours in the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.metadata import stem
from gleanery.operators.index import Index

PAGE_CHARS = 4000


def is_page(ident: Column, page_id: Column, filename: Column) -> Column:
    """An identifier of digits alone is a page id, any other a file name."""
    return F.when(ident.rlike(r"^\d+$"), page_id == ident.try_cast("long")).otherwise(filename == ident)


def lookups(index: Index, idents: DataFrame) -> DataFrame:
    """(pos, ident) rows with their page's columns, null where there is none: two equality joins, by id and by name."""
    digits = F.col("ident").rlike(r"^\d+$")
    pages = index.pages
    by_id = idents.where(digits).withColumn("id", F.col("ident").try_cast("long")).join(pages, "id", "left").select("pos", "ident", *pages.columns)
    by_id = by_id.withColumn("id", F.when(F.col("filename").isNotNull(), F.col("id")))
    by_name = idents.where(~digits).join(pages, F.col("ident") == F.col("filename"), "left").select("pos", "ident", *pages.columns)
    return by_id.unionByName(by_name)


def page_bodies(index: Index, found: DataFrame) -> DataFrame:
    """With ``total_chunks``, ``chars``, ``shown`` (the first chunk of a long page, else all of it) and ``truncated``."""
    first = index.chunks.where("chunk_index = 0").select(F.col("page_id").alias("id"), "total_chunks", F.col("body").alias("head"))
    long = (F.col("total_chunks") > 1) | (F.length("body") > PAGE_CHARS)
    return found.join(first, "id", "left").withColumns({"chars": F.length("body"), "truncated": F.coalesce(long, F.lit(False)), "shown": F.when(long, F.col("head")).otherwise(F.col("body"))})


def get_page(index: Index, ident: str, chunk: int | None = None) -> dict:
    """One page as a record; ``chunk`` asks for one of its chunks. Raises LookupError for what is not there."""
    spark = index.spark
    page = lookups(index, spark.createDataFrame([(0, str(ident))], "pos int, ident string")).where("filename is not null").first()
    if page is None:
        raise LookupError(f"no page {ident}")
    chunks = index.chunks.where(F.col("page_id") == page["id"]).orderBy("chunk_index")
    listed = [{"index": r["chunk_index"], "chars": r["chars"]} for r in chunks.select("chunk_index", "chars").collect()]
    if chunk is None:
        truncated = len(listed) > 1 or len(page["body"]) > PAGE_CHARS
        body = chunks.where("chunk_index = 0").first()["body"] if truncated else page["body"]
    else:
        row = chunks.where(F.col("chunk_index") == int(chunk)).first()
        if row is None:
            raise LookupError(f"page {ident} has {len(listed)} chunks, no chunk {chunk}")
        body, truncated = row["body"], len(listed) > 1
    names = ("id", "filename", "title", "section", "kind", "book")
    return {k: page[k] for k in names} | {"chars": len(page["body"]), "chunk_index": chunk or 0, "total_chunks": len(listed), "truncated": truncated, "chunks": listed, "body": body}


def budgeted(found: DataFrame, max_chars: int, request: str | None = None) -> DataFrame:
    """For (pos, filename or null, shown) rows of one request (or of each ``request``): ``state`` is returned, missing, overflow or unread.

    Pages are taken in order until the budget is reached or one does not fit; that one's length still counts (``running``).
    """
    w = (Window.partitionBy(request) if request else Window.partitionBy()).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a request's list
    size = F.coalesce(F.length("shown"), F.lit(0))
    rows = found.withColumn("running", F.sum(size).over(w)).withColumn("before", F.col("running") - size)
    # running only grows: whatever follows an overflow starts above the budget, so it is unread as well
    open_ = F.col("before") < max_chars
    state = F.when(~open_, "unread").when(F.col("filename").isNull(), "missing").when(F.col("running") > max_chars, "overflow").otherwise("returned")
    return rows.withColumn("state", state).drop("before")


def get_pages(index: Index, idents: list[str], max_chars: int = PAGE_CHARS) -> dict:
    asked = index.spark.createDataFrame([(i, str(x)) for i, x in enumerate(idents)], "pos int, ident string")
    rows = budgeted(page_bodies(index, lookups(index, asked)), max_chars).orderBy("pos").collect()
    back, missing = [r for r in rows if r["state"] == "returned"], [r["ident"] for r in rows if r["state"] == "missing"]
    read = [r["running"] for r in rows if r["state"] in ("returned", "overflow")]
    names = ("id", "filename", "title", "section", "kind", "book", "chars", "total_chunks", "truncated")
    return {"requested": len(idents), "returned": len(back), "missing": missing, "total_chars": max(read, default=0), "truncated": len(back) < len(idents) - len(missing), "pages": [{k: r[k] for k in names} | {"body": r["shown"]} for r in back]}


def sections(pages: DataFrame) -> DataFrame:
    return pages.groupBy("section").agg(F.count(F.lit(1)).alias("count"))


def groups(pages: DataFrame, section: str) -> DataFrame:
    """Pages of a section by what stands before the first dot of their names."""
    top = F.substring_index(stem(F.col("filename")), ".", 1)
    return pages.where(F.col("section") == section).groupBy(top.alias("name")).agg(F.count(F.lit(1)).alias("count"))


def hierarchy(index: Index, section: str | None = None) -> dict:
    if section:
        return {"section": section, "groups": [r.asDict() for r in groups(index.pages, section).orderBy("name").collect()]}
    return {"sections": [r.asDict() for r in sections(index.pages).orderBy("section").collect()]}


def neighbour_lists(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``filename, outgoing, incoming`` of every page, repeats kept, in order."""
    out = links.groupBy(F.col("src").alias("filename")).agg(F.sort_array(F.collect_list("dst")).alias("outgoing"))
    back = links.groupBy(F.col("dst").alias("filename")).agg(F.sort_array(F.collect_list("src")).alias("incoming"))
    none = F.array().cast("array<string>")
    return pages.select("filename", "title").join(out, "filename", "left").join(back, "filename", "left").withColumns({"outgoing": F.coalesce("outgoing", none), "incoming": F.coalesce("incoming", none)})


def related(index: Index, ident: str) -> dict:
    page = lookups(index, index.spark.createDataFrame([(0, str(ident))], "pos int, ident string")).where("filename is not null").first()
    if page is None:
        raise LookupError(f"no page {ident}")
    name = page["filename"]
    out = [r["dst"] for r in index.links.where(F.col("src") == name).orderBy("dst").collect()]
    back = [r["src"] for r in index.links.where(F.col("dst") == name).orderBy("src").collect()]
    return {"id": name, "title": page["title"], "outgoing": out, "incoming": back}
