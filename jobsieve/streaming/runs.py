"""Log of ingest runs, one row per micro-batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.schema import RUN


def write_run(spark: SparkSession, root: str, batch_id: int, started: dt.datetime, status: str, duration_ms: int,
              found: int, new: int, skipped: int, error: str | None) -> None:
    values = (batch_id, started, status, duration_ms, found, new, skipped, error)
    row = spark.range(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, RUN.fields)])
    row.write.mode("overwrite").parquet(f"{root}/run={batch_id}")


def run_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUN).parquet(root)


def run_stats(runs: DataFrame) -> DataFrame:
    """One row: run counts, the latest run and the latest error."""
    ok, failed = F.col("status") == "success", F.col("status") == "failed"
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("successful_runs"),
        F.count_if(failed).alias("failed_runs"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, F.col("started_at"))).alias("last_error"),
        F.max("started_at").alias("last_run"), F.max_by("status", "started_at").alias("last_status"),
        F.max_by("duration_ms", "started_at").alias("last_duration_ms"),
        F.max_by("jobs_found", "started_at").alias("last_jobs_found"),
        F.max_by("new_jobs", "started_at").alias("last_new_jobs"),
        F.max_by("skipped_jobs", "started_at").alias("last_skipped_jobs"))
