"""Dated exports of postings: CSV at the edge, Parquet inside."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions.text import blank_to_null
from jobsieve.operators.keyed import filter_new
from jobsieve.schema import EXPORT_FILE, EXPORT_HEADERS, EXPORT_LIMITS, POSTING_COLUMNS

# Name parts of the export files.
EXPORT_PREFIX = "regular_jobs_quick_auto_"
EXPORT_NAME = r"regular_jobs_quick_auto_(\d{4}-\d{2}-\d{2})\.csv"
PARTITION_NAME = r"export_date=(\d{4}-\d{2}-\d{2})"
MAX_RECORDS_PER_FILE = 500_000


def export_name(date: str, quick: bool = False, auto: bool = False, kind: str = "regular_jobs") -> str:
    return f"{kind}_{'quick_' if quick else ''}{'auto_' if auto else ''}{date}.csv"


def batch_name(batch_no: int, date: str) -> str:
    return f"jobs_batch_{batch_no}_{date}.csv"


def with_export_folders(df: DataFrame, date: str, quick: bool = False, auto: bool = False) -> DataFrame:
    """Adds the folder columns of an export, `mode` and `export_date`, the table form of its file name."""
    mode = "_".join(word for word, on in (("quick", quick), ("auto", auto)) if on) or "full"
    return df.withColumn("mode", F.lit(mode)).withColumn("export_date", F.lit(date))


def _defaults() -> list:
    out = []
    for name, header in EXPORT_HEADERS.items():
        value = F.coalesce(F.col(f"`{header}`"), F.lit(""))
        if name == "is_sponsored":
            value = F.coalesce(blank_to_null(value), F.lit("No"))
        out.append(value.alias(name))
    return out


def read_postings_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Postings of CSV exports with internal names; missing values are ''.

    Folder columns such as `export_date` come along. Quoted line breaks keep a file from
    being split, so one file is one task: the sink bounds the rows of a file.
    """
    raw = (spark.read.schema(EXPORT_FILE).option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    extra = [c for c in raw.columns if c not in EXPORT_HEADERS.values()]
    return raw.select(*_defaults(), *extra)


def export_rows(df: DataFrame, columns: Sequence[str] = POSTING_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as written to CSV: header names, length limits, defaults."""
    out = []
    for name in columns:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if name in EXPORT_LIMITS:
            value = F.substring(value, 1, EXPORT_LIMITS[name])
        if name == "is_sponsored":
            value = F.coalesce(blank_to_null(value), F.lit("No"))
        out.append(value.alias(EXPORT_HEADERS[name]))
    return df.select(*out, *keep)


def _csv_writer(df: DataFrame, mode: str):
    return (df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE))


def write_postings_csv(df: DataFrame, path: str, columns: Sequence[str] = POSTING_COLUMNS,
                       partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """All rows as CSV, fully quoted. Leave columns out for the 15-column form."""
    writer = _csv_writer(export_rows(df, columns, partition_by), mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def _file_dates(df: DataFrame) -> list[tuple[str, str]]:
    """(date, path) of the files that a table reads and that a folder's or file's name dates."""
    found = ((re.search(PARTITION_NAME, f) or re.search(EXPORT_NAME, f), f) for f in df.inputFiles())
    return [(m[1], f) for m, f in found if m]


def export_dates(df: DataFrame) -> list[str]:
    """Dates of the export folders or files that a table reads, oldest first; from their names, no file is opened."""
    return sorted({day for day, _ in _file_dates(df)})


def export_files(df: DataFrame, date: str) -> list[str]:
    """Paths of one day's files."""
    return [f for day, f in _file_dates(df) if day == date]


def latest_export(df: DataFrame) -> DataFrame:
    """Rows of the newest export. Its date comes from the folders' names, so that the filter is a literal and one folder
    is read; only a table that is no table of export folders is searched for its newest date."""
    dates = export_dates(df)
    if dates:
        return export_for(df, dates[-1])
    return df.where(F.col("export_date") == df.agg(F.max("export_date")).scalar())


def export_for(df: DataFrame, date: str) -> DataFrame:
    """Rows of one day; none when that day has no export."""
    return df.where(F.col("export_date") == F.lit(date).cast(df.schema["export_date"].dataType))


def list_exports(spark: SparkSession, path: str, with_counts: bool = True) -> DataFrame:
    """Catalog of export files, newest first: name, date, size in KB, time of change, rows.

    File contents are not read for it; row counts come from a scan that needs no column.
    """
    def scan(reader):
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")

    # Both sides name a file as Spark's scan does, so they meet whatever the file system.
    files = scan(spark.read.format("binaryFile")).load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("last_modified"))
    date = F.coalesce(blank_to_null(F.regexp_extract("path", EXPORT_NAME, 1)),
                      blank_to_null(F.regexp_extract("path", PARTITION_NAME, 1)), F.lit("unknown"))
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), date.alias("date"),
                       F.round(F.col("length") / 1024, 2).alias("size_kb"), "last_modified")
    if with_counts:
        rows = scan(spark.read.schema(EXPORT_FILE).option("header", True).option("multiLine", True).option("escape", '"')).csv(path)
        counts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("job_count"))
        # A file that the scan gives no row of holds none.
        out = out.join(counts, "path", "left").withColumn("job_count", F.coalesce("job_count", F.lit(0)))
    return out.orderBy(F.desc("date"), "path")


def append_export(df: DataFrame, root: str, date: str, export: DataFrame | None = None, batch_id: int | None = None) -> int:
    """Adds the postings that the day's export does not hold yet; returns how many were written.

    With `batch_id` the rows go to a folder of that batch, which a repeated run replaces.
    """
    fresh = df if export is None else filter_new(df, export)
    seen = Observation()
    out = fresh.withColumn("export_date", F.lit(date)).observe(seen, F.count(F.lit(1)).alias("n"))
    if batch_id is None:
        out.write.mode("append").partitionBy("export_date").parquet(root)
    else:
        (out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("export_date")
         .parquet(f"{root}/batch_id={batch_id}"))
    return seen.get["n"]


def write_batches(df: DataFrame, root: str, order: Sequence[str], size: int) -> None:
    """One folder per batch of `size` rows in the given order."""
    from jobsieve.operators.query import with_batch_no

    numbered = with_batch_no(df, order, size)
    numbered.repartition("batch_no").write.mode("overwrite").partitionBy("batch_no").parquet(root)
