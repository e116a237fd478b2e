"""Queries over the exports, by day or over the newest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.operators.query import latest_postings, query_info
from jobsieve.operators.stats import export_stats
from jobsieve.sources.exports import export_dates, export_files, export_for, latest_export


def choose_export(exports: DataFrame, date: str | None = None) -> DataFrame:
    return export_for(exports, date) if date else latest_export(exports)


def file_facts(exports: DataFrame, date: str | None = None) -> DataFrame | None:
    """One row about the files of one day's export (the newest one's by default): how many, size in KB, time of the last
    change. Names pick the files and no content is read. None where the table has no files of that day."""
    days = [date] if date else export_dates(exports)[-1:]
    files = export_files(exports, days[0]) if days else []
    if not files:
        return None
    facts = exports.sparkSession.read.format("binaryFile").load(files).select("_metadata")
    return facts.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("_metadata.file_size") / 1024, 2).alias("size_kb"),
                     F.max("_metadata.file_modification_time").alias("last_modified"))


def jobs(exports: DataFrame, date: str | None = None, search: str | None = None, location: str | None = None,
         salary_min: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a query and the one-row description of it, with the facts of the export's files."""
    export, facts = choose_export(exports, date), file_facts(exports, date)
    info = query_info(export, search, location, salary_min, limit)
    if facts is not None:
        info = info.crossJoin(F.broadcast(facts))     # two tables of one row
    return latest_postings(export, search, location, salary_min, limit), info


def statistics(exports: DataFrame, date: str | None = None) -> DataFrame:
    """All statistics of an export as one row of structs, with those of its files as `file_info`."""
    stats, facts = export_stats(choose_export(exports, date)), file_facts(exports, date)
    if facts is None:
        return stats
    return stats.crossJoin(F.broadcast(facts.select(F.struct(*facts.columns).alias("file_info"))))
