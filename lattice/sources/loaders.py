"""Documents from files: text by extension, PDF and images through optional or injected readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = ("txt", "md", "py", "js", "json")
IMAGES = ("png", "jpg", "jpeg", "gif", "webp")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, raw, length) of any files."""
    return with_extension(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("raw"), "length"))


def with_extension(files: DataFrame) -> DataFrame:
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def pdf_text(raw: bytes) -> str:
    """The text of a PDF's pages, a line feed after each; needs pypdf."""
    import io

    import pypdf

    return "".join((page.extract_text() or "") + "\n" for page in pypdf.PdfReader(io.BytesIO(raw)).pages)


def contents(files: DataFrame, pdf: Callable[[bytes], str] | None = pdf_text, image: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, extension, content): text decoded with bad bytes replaced; PDFs and images by their readers, null without one.

    An unknown extension is tried as text. Text never leaves the JVM.
    """
    plain = files.where(~F.col("extension").isin("pdf", *IMAGES)).select("path", "extension", F.try_validate_utf8(F.col("raw").cast("string")).alias("ok"), F.make_valid_utf8(F.col("raw").cast("string")).alias("repaired"))
    text = plain.select("path", "extension", F.coalesce("ok", F.replace("repaired", F.lit("�"), F.lit(""))).alias("content"))
    readers = {"pdf": pdf} | dict.fromkeys(IMAGES, image)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "extension": part["extension"], "content": [reader(bytes(raw)) if (reader := readers[e]) else None for e, raw in zip(part["extension"], part["raw"])]})

    other = files.where(F.col("extension").isin("pdf", *IMAGES)).select("path", "extension", "raw").mapInPandas(read, "path string, extension string, content string")
    return text.unionByName(other)


def load(spark: SparkSession, path: str, **readers) -> DataFrame:
    return contents(read_bytes(spark, path), **readers)
