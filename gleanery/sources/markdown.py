"""Markdown files as a source and a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stem(path):
    return F.regexp_replace(F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))), r"\.md$", "")


def read(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``filename`` (stem), ``text`` and ``source_path`` of the files of a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(_stem(F.col("path")).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("path").alias("source_path"))


def _writer(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for frame in frames:
            for name, body in zip(frame["filename"], frame["body"], strict=True):
                with fs.open_output_stream(f"{root}/{name}.md") as out:
                    out.write(((body or "").strip() + "\n").encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return run


def write(pages: DataFrame, folder: str) -> int:
    """A file for every (filename, body) row under a URI that all executors share; how many were written."""
    return pages.select("filename", "body").mapInPandas(_writer(folder), "n long").agg(F.sum("n")).first()[0] or 0
