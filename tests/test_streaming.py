import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobsieve.functions.profile import primary_profile
from jobsieve.operators.extract import extract_postings
from jobsieve.schema import PAGE
from jobsieve.streaming import ingest as I
from jobsieve.streaming.runs import run_log, run_stats

DAY = dt.datetime(2025, 7, 1, 8, tzinfo=dt.timezone.utc)
PROFILE = primary_profile("listings.example.com")


def page(i, text=""):
    return (i, f"https://jobs.example.com/cls/{60000000 + i}.html", f"<title>Job {i}</title><body>Salary: {1000 + i} {text}</body>")


def write_pages(spark, path, rows):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, paths, clock=DAY):
    rows = extract_postings(spark.readStream.schema(PAGE).parquet(source), PROFILE, "now")
    I.ingest(rows, paths, available_now=True, clock=lambda: clock).awaitTermination()


def test_stream_equals_batch_and_skips_seen(spark, tmp_path):
    source, paths = str(tmp_path / "pages"), I.IngestPaths(str(tmp_path / "work"))
    first = [page(i) for i in range(20)] + [page(99, "Verify you are human")]
    write_pages(spark, source, first)
    run(spark, source, paths)
    batch = extract_postings(spark.createDataFrame(first, PAGE), PROFILE, "now")
    cols = batch.columns
    assert sorted(map(str, I.read_exports(spark, paths).select(cols).collect())) == sorted(map(str, batch.collect()))
    write_pages(spark, source, [page(i) for i in range(10, 25)])
    run(spark, source, paths)
    assert I.read_exports(spark, paths).count() == 25
    log = sorted((r["jobs_found"], r["new_jobs"], r["skipped_jobs"]) for r in run_log(spark, paths.runs).collect())
    assert log == [(15, 5, 10), (20, 20, 0)]
    assert run_stats(run_log(spark, paths.runs)).first()["successful_runs"] == 2
    status = I.step_status(spark.read.schema(PAGE).parquet(source), I.read_exports(spark, paths)).first()
    assert (status["total"], status["processed"], status["is_complete"]) == (26, 25, False)


def test_seen_ids_expire(spark, tmp_path):
    source, paths = str(tmp_path / "pages"), I.IngestPaths(str(tmp_path / "work"))
    write_pages(spark, source, [page(1)])
    run(spark, source, paths)
    write_pages(spark, source, [page(1)])
    run(spark, source, paths, DAY + dt.timedelta(days=5))
    assert I.read_exports(spark, paths).count() == 1
    write_pages(spark, source, [page(1)])
    run(spark, source, paths, DAY + dt.timedelta(days=20))
    assert I.read_exports(spark, paths).count() == 2


def test_repeated_batch_replaces_its_output(spark, tmp_path):
    paths = I.IngestPaths(str(tmp_path))
    handle = I.batch_writer(paths, clock=lambda: DAY)
    rows = extract_postings(spark.createDataFrame([page(i) for i in range(5)], PAGE), PROFILE, "now")
    for _ in range(2):
        handle(rows, 0)
    assert I.read_exports(spark, paths).count() == 5
    assert run_log(spark, paths.runs).count() == 1
    I.batch_writer(paths, clock=lambda: DAY + dt.timedelta(days=1))(rows, 0)
    assert I.read_exports(spark, paths).count() == 5 and run_log(spark, paths.runs).count() == 1
    handle(rows, 1)
    assert I.read_exports(spark, paths).count() == 5 and run_log(spark, paths.runs).count() == 2


def test_failed_batch_is_logged_and_raised(spark, tmp_path):
    paths = I.IngestPaths(str(tmp_path))
    rows = extract_postings(spark.createDataFrame([page(1)], PAGE), PROFILE, "now")
    with pytest.raises(Exception):
        I.batch_writer(paths, clock=lambda: DAY)(rows.withColumn("title", F.raise_error(F.lit("boom")).cast("string")), 0)
    row = run_stats(run_log(spark, paths.runs)).first()
    assert row["failed_runs"] == 1 and "boom" in row["last_error"]


@pytest.mark.parametrize("spread", [1, 8])
def test_dedup_stream(spark, tmp_path, spread):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = dt.datetime(2025, 7, 1)

    def feed(rows):
        spark.createDataFrame(rows, "posting_id string, scraped_at timestamp, n int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("posting_id string, scraped_at timestamp, n int").parquet(source)
        (I.dedup_stream(stream, "7 days", spread=spread).writeStream.format("parquet").option("checkpointLocation", out + "-cp")
         .trigger(availableNow=True).start(out).awaitTermination())
        return sorted(r["posting_id"] or "" for r in spark.read.parquet(out).collect())

    assert feed([("hot", at, i) for i in range(100)] + [("a", at, 1), ("", at, 2), ("", at, 2), (None, at, 3)]) == ["", "", "", "a", "hot"]
    assert feed([("hot", at + dt.timedelta(days=1), 1), ("b", at + dt.timedelta(days=1), 1)]) == ["", "", "", "a", "b", "hot"]
