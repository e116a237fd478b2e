"""Page snapshots: tables of (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsieve.schema import PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).parquet(path)


def stream_pages(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """New snapshot files of a folder; `max_files` or `max_bytes` bound one micro-batch."""
    reader = spark.readStream.schema(PAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)
