"""Recurring ingest: page snapshots arrive, new postings go to the day's export and the seen log."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobsieve.functions.profile import ExtractionProfile
from jobsieve.functions.text import blank_to_null
from jobsieve.operators.extract import extract_postings
from jobsieve.operators.keyed import NO_KEY, dedup, filter_new, seen_rows
from jobsieve.operators.keyed import progress as progress_of
from jobsieve.sources.pages import stream_pages
from jobsieve.sources.store import append_seen_log, compact_seen_log, expire_seen_log, read_seen_log
from jobsieve.streaming.runs import write_run

EVERY = "5 minutes"


def dedup_stream(df: DataFrame, ttl: str = "7 days", key: str = "posting_id", ts: str = "scraped_at",
                 spread: int = 16) -> DataFrame:
    """Each id once within the time to live, by event time. Rows without id pass untouched.

    A first stateful step works on (id, part of the row's hash), so an id that makes up
    much of the stream reaches the second step as at most `spread` rows. `spread=1` leaves
    the first step out.

    The state drops rows that arrive behind the watermark, whether or not their id was seen. Where late rows must not be
    lost, write the stream with `dedup_writer` instead, whose memory is the log.
    """
    has_key = F.coalesce(F.col(key) != "", F.lit(False))
    timed = df.withWatermark(ts, ttl)
    keyed = timed.where(has_key)
    if spread > 1:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        keyed = keyed.withColumn("_part", part).dropDuplicatesWithinWatermark([key, "_part"]).drop("_part")
    return keyed.dropDuplicatesWithinWatermark([key]).unionByName(timed.where(~has_key))


def dedup_writer(out: str, log: str, ttl_days: int = 7, key: str = "posting_id",
                 ts: str = "scraped_at", order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Handler of micro-batches: each id once within the time to live, by event time, however late its rows arrive.

    Of a batch the first row of each id counts, ties by `order`. It is new unless the log holds a row of the id within the time to live
    before or after it; only the day folders within that reach of the batch's own times are read. So a late row passes
    the state of a stream by and meets the log in a batch anti-join: a late id that was never seen is kept, a late
    repeated one is not. Rows without an id pass untouched; rows with an id but without a time are told apart by id
    only within their batch. Output and log are written to folders of the batch, which a repeated batch replaces.
    """
    def handle(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        reach = batch_df.agg(F.min(ts).cast("date").alias("low"), F.max(ts).cast("date").alias("high")).first()
        once = dedup(batch_df, key, [ts, *order])
        if reach["low"] is not None:
            around = dt.timedelta(days=ttl_days + 1)
            known = read_seen_log(spark, log, (reach["low"] - around).isoformat(), batch_id, (reach["high"] + around).isoformat())
            known = known.select(F.col("posting_id").alias("_key"), F.col("scraped_date").alias("_at"))
            micros = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_at")))
            near = (F.col(key).cast("string") == F.col("_key")) & (micros <= ttl_days * 86_400_000_000)
            once = once.join(known, near, "left_anti")
        target = f"{out}/batch_id={batch_id}"
        once.write.mode("overwrite").parquet(target)
        written, at = spark.read.schema(once.schema).parquet(target), F.col(ts).cast("timestamp")
        keyed = written.where(F.coalesce(F.col(key).cast("string") != "", F.lit(False)) & at.isNotNull())
        none = F.lit(None).cast("string")
        rows = keyed.select(F.col(key).cast("string").alias("posting_id"), none.alias("title"), none.alias("url"),
                            at.alias("scraped_date"), at.alias("first_scraped"), at.alias("last_updated"))
        append_seen_log(rows, log, F.col("scraped_date").cast("date"), batch_id)

    return handle


@dataclass(frozen=True)
class IngestPaths:
    """Folders of one ingest below a shared root."""

    root: str

    @property
    def export(self) -> str:
        return f"{self.root}/export"

    @property
    def seen(self) -> str:
        return f"{self.root}/seen"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def batch_writer(paths: IngestPaths, ttl_days: int = 7,
                 clock: Callable[[], dt.datetime] | None = None) -> Callable[[DataFrame, int], None]:
    """Handler of one micro-batch: keep what is new, append it, remember it, log the run.

    Everything is written to folders of the batch number, so a repeated batch replaces its
    own output, also on a later day. New means: not in the seen log of the last days, read by day folders and
    without this batch's own rows. Each posting of the batch is kept once. Pages are read and parsed once, in the
    write of the export; the store rows come from what it wrote. Days past the time to live then leave the log, and
    closed days are folded into one folder each.
    """
    now_of = clock or (lambda: dt.datetime.now(dt.timezone.utc))

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        started, tick = now_of(), time.monotonic()
        day = started.date().isoformat()
        since = (started.date() - dt.timedelta(days=ttl_days)).isoformat()

        def log(status: str, found: int = 0, new: int = 0, error: str | None = None) -> None:
            took = int((time.monotonic() - tick) * 1000)
            write_run(spark, paths.runs, batch_id, started, status, took, found, new, found - new, error)

        try:
            # Pages are parsed in one pass: both counts come with the write.
            seen, kept = Observation(), Observation()
            rows = batch_df.observe(seen, F.count(F.lit(1)).alias("n"))
            # A row without an id gets a key of its own: two branches, as `keep` has them, would parse each page twice.
            own = F.concat(F.lit(NO_KEY), F.monotonically_increasing_id().cast("string"))
            keyed = rows.withColumn("_once", F.coalesce(blank_to_null(F.col("posting_id")), own))
            once = dedup(keyed, "_once", ["scraped_at", "url"], null_key="collapse").drop("_once")
            known = read_seen_log(spark, paths.seen, since, skip_batch=batch_id)
            fresh = filter_new(once, known).withColumn("export_date", F.lit(day))
            out = fresh.observe(kept, F.count(F.lit(1)).alias("n"))
            target = f"{paths.export}/batch_id={batch_id}"
            (out.write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("export_date").parquet(target))
            found, new = seen.get["n"], kept.get["n"]
            if new:
                written, now = spark.read.schema(fresh.schema).parquet(target), F.lit(started)
                append_seen_log(seen_rows(written, now, [F.desc("scraped_at"), "url"]), paths.seen, day, batch_id)
            expire_seen_log(spark, paths.seen, since)
            compact_seen_log(spark, paths.seen, day)
            log("success", found, new)
        except Exception as error:
            log("failed", error=str(error))
            raise

    return handle


def ingest(postings: DataFrame, paths: IngestPaths, every: str = EVERY, available_now: bool = False,
           ttl_days: int = 7, clock: Callable[[], dt.datetime] | None = None) -> StreamingQuery:
    """Starts the recurring write of a posting stream. `available_now` takes what is there and stops."""
    writer = postings.writeStream.foreachBatch(batch_writer(paths, ttl_days, clock))
    writer = writer.option("checkpointLocation", paths.checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def ingest_pages(spark: SparkSession, source: str, paths: IngestPaths, profile: ExtractionProfile,
                 every: str = EVERY, max_files: int | None = None, max_bytes: str | None = None,
                 available_now: bool = False, scraped_at: Column | str | None = None) -> StreamingQuery:
    """Snapshot folder to exports. Each micro-batch, the first one of a backlog too, takes `max_files` files or `max_bytes`
    bytes at most; one of them must be given. No posting is dropped."""
    if not max_files and not max_bytes:
        raise ValueError("give max_files or max_bytes: the first batch of a backlog has no other bound")
    pages = stream_pages(spark, source, max_files, max_bytes)
    return ingest(extract_postings(pages, profile, scraped_at), paths, every, available_now)


def step_ingest(spark: SparkSession, source: str, paths: IngestPaths, profile: ExtractionProfile,
                files_per_step: int, scraped_at: Column | str | None = None) -> None:
    """Works off all snapshots in steps and returns. A stopped run goes on where it ended."""
    ingest_pages(spark, source, paths, profile, max_files=files_per_step, available_now=True,
                 scraped_at=scraped_at).awaitTermination()


def read_exports(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    return spark.read.parquet(paths.export)


def step_status(pages: DataFrame, exports: DataFrame) -> DataFrame:
    """How far a step-wise ingest has come, by address."""
    return progress_of(pages, exports, "url")
