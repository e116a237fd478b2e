"""Results as JSON rows, and captured service responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.schema import RESPONSE


def to_json_rows(df: DataFrame) -> DataFrame:
    """One column `json`; NULL fields are left in."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_response_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows under `data` and the summary of captured responses, one response per file or per line."""
    raw = spark.read.schema(RESPONSE).option("multiLine", not lines).json(path)
    return raw.select(F.inline("data")), raw.select("success", "count", "scraped_at", "summary.*")
