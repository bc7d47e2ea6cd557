"""All pages of a build: books in containers, tools' transcripts and Markdown files, as one table."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import storage
from gleanery.config import Config, Source
from gleanery.sources import container, discovery, html, markdown, transcripts

SCHEMA = "filename string, text string, source_path string"


def book_pages(spark: SparkSession, sources: list[Source], folder: str | None = None) -> DataFrame:
    """``book, prefix, path, page`` of the HTML pages in the sources' containers, and ``error`` of a container that cannot
    be read.  A container without a folder of its own is looked for in ``folder``."""
    books = []
    for s in sources:  # a handful of books
        at = s.container if "/" in s.container or not folder else f"{folder.rstrip('/')}/{s.container}"
        rows = container.read_containers(spark, at)
        books.append(rows.select(F.lit(s.id).alias("book"), F.lit(s.prefix).alias("prefix"), "path", "content", "error"))
    rows = functools.reduce(DataFrame.unionByName, books)
    rows = rows.where(F.col("error").isNotNull() | html.is_page(F.col("path"), F.col("content")))
    return rows.select("book", "prefix", "path", html.decoded(F.col("content")).alias("page"), "error")


def books(spark: SparkSession, sources: list[Source], folder: str | None = None, scheme: str = html.LINK_SCHEME) -> tuple[DataFrame, list[str]]:
    """Pages of the books as ``SCHEMA``, and what could not be read or converted."""
    read = storage.written(book_pages(spark, sources, folder), "book_pages")
    made = storage.written(html.convert(read.where("error is null").drop("error"), scheme), "converted")
    failed = read.where("error is not null").select("book", "error").unionByName(made.where("error is not null").select(F.concat_ws(":", "book", "path").alias("book"), "error"))
    pages = made.where("error is null").select(F.regexp_replace("filename", r"\.md$", "").alias("filename"), F.col("markdown").alias("text"), F.concat_ws(":", "book", "path").alias("source_path"))
    return pages, [f"{r['book']}: {r['error']}" for r in failed.orderBy("book").limit(100).collect()]


def tool_pages(spark: SparkSession, config: Config) -> DataFrame:
    """Pages of the command line tool and of the utilities that the settings name, if they are there."""
    made: dict[str, str] = {}
    if config.tool and Path(config.tool).exists():
        made |= transcripts.render(transcripts.collect(config.tool, Path(config.tool).stem, lang=config.lang), config.tool_prefix)
    if config.utilities and Path(config.utilities).is_dir():
        tools = transcripts.collect_utilities(config.utilities)
        made |= transcripts.render_utilities(tools, config.utility_prefix) if tools else {}
    pages = transcripts.pages(spark, made)
    return pages.withColumn("source_path", F.col("filename"))


def consolidated(spark: SparkSession, config: Config, lang: str | None = None, ids: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Books in containers, else the Markdown files of the corpus folder; tools' pages beside them, where no other page has
    the name.  Nothing of the corpus folder is touched."""
    sources = config.sources_for(lang, ids)
    if ids and (unknown := sorted(set(ids) - {s.id for s in sources})):
        raise LookupError(f"no such source: {', '.join(unknown)}")
    if sources:
        pages, failed = books(spark, sources, config.containers or discovery.newest(), config.link_scheme)
    else:
        pages, failed = markdown.read(spark, config.corpus), []
    tools = tool_pages(spark, config)
    if tools.isEmpty():
        return pages, failed
    return pages.unionByName(tools.join(pages.select("filename"), "filename", "left_anti")), failed
