"""Readers of texts and documents in files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def converted(spark: SparkSession, path: str, convert: Callable[[bytes], str | None]) -> DataFrame:
    """(path, text) of binary documents by a converter such as a PDF reader; null where it fails."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                try:
                    out.append(convert(data))
                except Exception:  # noqa: BLE001 - a document that can't be read has no text
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["path", "text"])

    return files.mapInArrow(run, "path string, text string")


def title_links(xml: Column) -> Column:
    """array<struct<title, link>> of the title and link elements of an XML text, in turn."""
    find = lambda tag: F.regexp_extract_all(xml, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1))
    return F.arrays_zip(find("title").alias("title"), find("link").alias("link"))
