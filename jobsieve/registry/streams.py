"""Queries that run the ingest as a stream over the given tables and read what it wrote."""

from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.registry.base import OWN_DOMAIN, STAMP, fx_posting_text, query, table
from jobsieve.registry.extraction import CHALLENGE, IDS, cascade
from jobsieve.session import scratch_path
from jobsieve.streaming import ingest as I
from jobsieve.streaming.runs import run_log, run_stats

T = ("fx_posting_text",)


@query("stream_dedup", """
WITH e AS (SELECT CASE WHEN event_type = 'purchase' THEN '' ELSE concat(CAST(user_id AS VARCHAR), '-', substring(event_type, 1, 2)) END AS posting_id FROM events)
SELECT posting_id, count(*) AS n FROM e WHERE posting_id = '' GROUP BY 1 UNION ALL SELECT DISTINCT posting_id, 1 FROM e WHERE posting_id <> ''""")
def stream_dedup(spark, sf):
    """The whole event table is one step of the stream, so each id comes through once."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.substring("event_type", 1, 2))
    rows = raw.select(F.when(F.col("event_type") == "purchase", "").otherwise(key).alias("posting_id"),
                      F.col("ts").cast("timestamp").alias("scraped_at"), "event_id")
    root = scratch_path(spark, "stream-dedup")
    (I.dedup_stream(rows, "40 days").writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return spark.read.parquet(f"{root}/out").groupBy("posting_id").agg(F.count("*").alias("n"))


LATE_ID = "CASE WHEN event_id % 50 = 3 THEN concat('late-', event_id) WHEN event_type = 'purchase' THEN '' ELSE concat(user_id, '-', substring(event_type, 1, 2)) END"
LATE_BATCH = "CASE WHEN event_id % 10 = 3 THEN 3 WHEN ts < TIMESTAMP_NTZ '2024-01-11' THEN 0 WHEN ts < TIMESTAMP_NTZ '2024-01-21' THEN 1 ELSE 2 END"
KEPT = "SELECT * FROM f{n} WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.posting_id = f{n}.posting_id AND abs(epoch_us(k.ts) - epoch_us(f{n}.ts)) <= 7 * 86400000000)"


@query("stream_dedup_late", f"""
WITH e AS (SELECT {LATE_ID} AS posting_id, ts, event_id, {LATE_BATCH.replace('TIMESTAMP_NTZ', 'TIMESTAMP')} AS b FROM events),
f AS (SELECT * FROM e WHERE posting_id <> '' QUALIFY row_number() OVER (PARTITION BY b, posting_id ORDER BY ts, event_id) = 1),
f0 AS (SELECT * FROM f WHERE b = 0), f1 AS (SELECT * FROM f WHERE b = 1), f2 AS (SELECT * FROM f WHERE b = 2), f3 AS (SELECT * FROM f WHERE b = 3),
k1 AS ({KEPT.format(n=1, known='f0')}), a1 AS (SELECT * FROM f0 UNION ALL SELECT * FROM k1),
k2 AS ({KEPT.format(n=2, known='a1')}), a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM k2),
k3 AS ({KEPT.format(n=3, known='a2')})
SELECT posting_id, event_id FROM a2 UNION ALL SELECT posting_id, event_id FROM k3 UNION ALL SELECT posting_id, event_id FROM e WHERE posting_id = ''""")
def stream_dedup_late(spark, sf):
    """Four batches with a time to live of seven days; the last one brings late rows, of ids seen and never seen."""
    root = scratch_path(spark, "stream-late")
    rows = table(spark, sf, "events").selectExpr(f"{LATE_ID} AS posting_id", "ts AS scraped_at", "event_id", f"{LATE_BATCH} AS b")
    handle = I.dedup_writer(f"{root}/out", f"{root}/log", order=("event_id",))
    for b in range(4):
        part = rows.where(F.col("b") == b).drop("b")
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").select("posting_id", "event_id")


PAGE = """concat('<html><head><title>', location, ' Jobs, ', title, ', ', CAST(seq AS STRING), ' - listings.example.com</title></head><body>',
  replace(body_text, '&', '&amp;'), '</body></html>')"""


def _ingested(spark, sf):
    """Snapshots in twenty-four files, taken eight at a time."""
    root = scratch_path(spark, "ingest")
    pages = fx_posting_text(spark, sf).select(F.col("seq").alias("page_id"), "url", F.expr(PAGE).alias("html"))
    pages.repartition(24).write.parquet(f"{root}/pages")
    paths = I.IngestPaths(f"{root}/work")
    I.step_ingest(spark, f"{root}/pages", paths, P.primary_profile(OWN_DOMAIN), files_per_step=8, scraped_at=STAMP)
    return f"{root}/pages", paths


ID = f"coalesce(nullif({cascade('body_text', IDS)}, ''), regexp_extract(url, 'cls/(\\d+)\\.html', 1))"


@query("stream_ingest", f"SELECT url, title, {ID} AS posting_id FROM fx_posting_text WHERE NOT {CHALLENGE}", T)
def stream_ingest(spark, sf):
    _, paths = _ingested(spark, sf)
    return I.read_exports(spark, paths).select("url", "title", "posting_id")


@query("stream_progress", f"""
WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT {CHALLENGE}) AS processed FROM fx_posting_text)
SELECT total, processed, total - processed AS remaining, CAST((200 * processed + total) // (2 * total) AS BIGINT) AS progress,
  processed >= total AS is_complete FROM c""", T)
def stream_progress(spark, sf):
    pages, paths = _ingested(spark, sf)
    return I.step_status(spark.read.parquet(pages), I.read_exports(spark, paths))


@query("stream_runs", f"""
SELECT CAST(count(*) AS BIGINT) AS jobs_found, CAST(count(*) AS BIGINT) AS new_jobs, CAST(0 AS BIGINT) AS skipped_jobs, 'success' AS last_status, CAST(0 AS BIGINT) AS failed_runs
FROM fx_posting_text WHERE NOT {CHALLENGE}""", T)
def stream_runs(spark, sf):
    _, paths = _ingested(spark, sf)
    runs = run_log(spark, paths.runs)
    return runs.agg(F.sum("jobs_found").alias("jobs_found"), F.sum("new_jobs").alias("new_jobs"), F.sum("skipped_jobs").alias("skipped_jobs"),
                    F.max_by("status", "started_at").alias("last_status"), F.count_if(F.col("status") == "failed").alias("failed_runs"))


@query("run_stats", """
WITH r AS (SELECT event_id AS batch_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 'timeout ' || CAST(event_id AS VARCHAR) END AS error, user_id FROM events)
SELECT count(*) AS total_runs, count(*) FILTER (WHERE status = 'success') AS successful_runs, count(*) FILTER (WHERE status = 'failed') AS failed_runs,
  arg_max(error, started_at) FILTER (WHERE status = 'failed') AS last_error, arg_max(status, started_at) AS last_status, arg_max(duration_ms, started_at) AS last_duration_ms,
  arg_max(user_id, started_at) AS last_jobs_found, arg_max(user_id, started_at) AS last_new_jobs, CAST(0 AS BIGINT) AS last_skipped_jobs FROM r""")
def run_stats_of_events(spark, sf):
    failed = F.col("event_type") == "error"
    runs = table(spark, sf, "events").select(
        F.col("event_id").alias("batch_id"), F.col("ts").alias("started_at"), F.when(failed, "failed").otherwise("success").alias("status"),
        F.floor(F.col("value") * 100).cast("bigint").alias("duration_ms"), F.col("user_id").alias("jobs_found"), F.col("user_id").alias("new_jobs"),
        F.lit(0).cast("bigint").alias("skipped_jobs"),
        F.when(failed, F.concat(F.lit("timeout "), F.col("event_id").cast("string"))).alias("error"))
    return run_stats(runs).drop("last_run")
