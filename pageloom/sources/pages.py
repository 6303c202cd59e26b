"""Sources: tables of pages, saved HTML files, ledgers, schema files, robots files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.charsets import decode_page
from pageloom.functions.core import join_facts, one_per_key

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table ``(page_id, url, html)``."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_html_files(
    spark: SparkSession, path: str, encoding: str | None = "UTF-8", headers: DataFrame | None = None
) -> DataFrame:
    """Saved pages, one per file: the file path is the URL, the id a hash of it.

    Without an ``encoding`` each file's own is found (see ``decode_page``) and told as ``charset``, with
    ``found_by``; ``headers(url, content_type)`` are what servers said of some files, if that is known.
    """
    files = spark.read.format("binaryFile").load(path)
    if encoding is None:
        files = files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), "content")
        return decode_files(files, headers)
    if encoding.upper() == "UTF-8":
        html = F.make_valid_utf8(F.col("content").cast("string"))  # bad bytes become marks, not errors
    else:
        html = F.decode("content", encoding)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), html.alias("html"))


def decode_files(files: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """``files(page_id, url, content)`` with ``html``, ``charset`` and ``found_by`` in place of their bytes."""
    if headers is None:
        files = files.withColumn("content_type", F.lit(None).cast("string"))
    else:
        once = one_per_key(headers.select("url", "content_type"), "url", F.col("content_type").isNull())
        files = join_facts(files, once, "url")
    return files.withColumn("_d", decode_page("content", "content_type")).select(
        "page_id", "url", "_d.html", "_d.charset", "_d.found_by")


def save_dom(pages: DataFrame, path: str) -> DataFrame:
    """Write pages with their node column and read them back.

    Parsing is the dearest step; jobs over the same corpus share this table.
    """
    pages.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same page table, read as files arrive."""
    return spark.readStream.schema(PAGE_SCHEMA).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events."""
    from pageloom.operators.ledger import EVENT_SCHEMA

    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``(path, content)``: schema files, rule files, robots files."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("content")
    )
