"""The seen log's folders: what a read opens, repeated batches, closed days, expiry; late rows of a stream."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from jobsieve.functions.profile import primary_profile
from jobsieve.sources import exports as E
from jobsieve.sources import store as S
from jobsieve.streaming import ingest as I

DAYS = ["2025-07-01", "2025-07-02", "2025-07-03"]


def rows(spark, *ids, at="2025-07-01 08:00:00"):
    df = spark.createDataFrame([(i,) for i in ids], "posting_id string")
    stamp = F.lit(at).cast("timestamp")
    return df.select("posting_id", F.lit("t").alias("title"), F.lit("u").alias("url"), stamp.alias("scraped_date"),
                     stamp.alias("first_scraped"), stamp.alias("last_updated"))


def ids(df):
    return sorted(r["posting_id"] for r in df.collect())


def test_a_read_opens_the_days_it_asks_for(spark, tmp_path):
    root = str(tmp_path / "log")
    for i, day in enumerate(DAYS):
        S.append_seen_log(rows(spark, f"a{i}"), root, day, i)
    some = S.read_seen_log(spark, root, "2025-07-02")
    assert ids(some) == ["a1", "a2"]
    assert {f.split("seen_day=")[1][:10] for f in some.inputFiles()} == {"2025-07-02", "2025-07-03"}
    assert ids(S.read_seen_log(spark, root, "2025-07-02", until="2025-07-02")) == ["a1"]
    assert ids(S.read_seen_log(spark, root, skip_batch=2)) == ["a0", "a1"]
    assert S.read_seen_log(spark, root, "2026-01-01").count() == 0
    assert S.read_seen_log(spark, str(tmp_path / "none")).schema == S.LOG_SCHEMA


def test_a_repeated_batch_counts_once(spark, tmp_path):
    root = str(tmp_path)
    S.append_seen_log(rows(spark, "a", "b"), root, DAYS[0], 0)
    S.append_seen_log(rows(spark, "a", "c"), root, DAYS[1], 0)      # again, on a later day
    S.append_seen_log(rows(spark, "d"), root, DAYS[1], 1)
    assert S.live_folders(spark, root) == [(DAYS[1], 0), (DAYS[1], 1)]
    assert ids(S.read_seen_log(spark, root)) == ["a", "c", "d"]
    S.append_seen_log(rows(spark).limit(0), root, DAYS[2], 1)       # a batch without rows
    assert ids(S.read_seen_log(spark, root)) == ["a", "c"]


def test_closed_days_are_folded_and_expire(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        S.append_seen_log(rows(spark, "hot", f"a{i}", at=f"2025-07-01 0{i}:00:00"), root, DAYS[i // 3], i)
    before = S.current_seen(S.read_seen_log(spark, root))
    want = sorted(map(str, before.collect()))
    assert S.compact_seen_log(spark, root, DAYS[1]) == 1 and S.compact_seen_log(spark, root, DAYS[1]) == 0
    assert S.live_folders(spark, root) == [(DAYS[0], -1), (DAYS[1], 3)]
    assert sorted(map(str, S.current_seen(S.read_seen_log(spark, root)).collect())) == want
    assert ids(S.read_seen_log(spark, root)).count("hot") == 2      # once a day
    assert S.vacuum_seen_log(spark, root) == 3
    assert S.expire_seen_log(spark, root, DAYS[1]) == 1 and not os.path.exists(f"{root}/seen_day={DAYS[0]}")
    assert ids(S.read_seen_log(spark, root)) == ["a3", "hot"]


def test_few_manifests_stay(spark, tmp_path):
    root = str(tmp_path)
    for i in range(9):
        S.append_seen_log(rows(spark, str(i)), root, DAYS[0], i)
    names = [n for n in os.listdir(f"{root}/_manifest") if n.endswith(".json") and not n.startswith(".")]
    assert len(names) == S.KEPT_MANIFESTS + 1 and S.read_seen_log(spark, root).count() == 9


def test_late_rows_of_a_stream(spark, tmp_path):
    at = dt.datetime(2025, 7, 20)
    handle = I.dedup_writer(str(tmp_path / "out"), str(tmp_path / "log"), order=["n"])

    def feed(batch, *found):
        df = spark.createDataFrame([(k, at + dt.timedelta(days=d) if d is not None else None, n) for k, d, n in found],
                                   "posting_id string, scraped_at timestamp, n int")
        handle(df, batch)
        return sorted((r["posting_id"] or "", r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = feed(0, ("a", 0, 1), ("a", 0, 2), ("b", 1, 3), ("", 0, 4), (None, 0, 5))
    assert first == [("", 4), ("", 5), ("a", 1), ("b", 3)]
    late = (("old", -19, 6), ("a", -6, 7), ("a", -8, 8), ("b", 9, 9), ("none", None, 10))
    want = [("", 4), ("", 5), ("a", 1), ("a", 8), ("b", 3), ("b", 9), ("none", 10), ("old", 6)]
    assert feed(1, *late) == want         # of "a" the row of day -8 is the first of its batch, and beyond the time to live
    assert feed(1, *late) == want         # repeated
    assert feed(2, ("old", -15, 11), ("new", -15, 12)) == sorted([*want, ("new", 12)])
    assert feed(3) == sorted([*want, ("new", 12)])


def test_ingest_has_a_bound(spark, tmp_path):
    with pytest.raises(ValueError):
        I.ingest_pages(spark, str(tmp_path), I.IngestPaths(str(tmp_path / "w")), primary_profile("x"))


def test_latest_export_is_one_pruned_scan(spark, tmp_path):
    root = str(tmp_path / "exports")
    df = spark.createDataFrame([(f"{i}", DAYS[i % 3]) for i in range(9)], "title string, export_date string")
    full = df.select(*[F.col(c) if c == "title" else F.lit("").alias(c) for c in E.POSTING_COLUMNS], "export_date")
    E.write_postings_csv(full, root, partition_by=("export_date",))
    latest = E.latest_export(E.read_postings_csv(spark, root))
    assert E.export_dates(latest)[-1] == DAYS[-1] and latest.count() == 3
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 1 and "Subquery" not in plan and "2025-07-03" in plan.split("PartitionFilters")[1][:200]
    assert E.latest_export(spark.createDataFrame([("a", "1"), ("b", "2")], "title string, export_date string")).first()[0] == "b"
