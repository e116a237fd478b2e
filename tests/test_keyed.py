import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import keyed as K
from jobsieve.registry.base import fx_postings


def ids(df, name="posting_id"):
    return sorted(r[name] or "" for r in df.collect())


def rows(spark, keys):
    return spark.createDataFrame([(k, f"u{i}") for i, k in enumerate(keys)], "posting_id string, url string")


def test_missing_keys_never_match(spark):
    left = rows(spark, ["1", "", None, "2", "2"])
    right = rows(spark, ["", None, "2"])
    assert ids(K.keep_unmatched(left, F.col("posting_id"), right, "posting_id")) == ["", "", "1"]
    assert ids(K.keep_matched(left, F.col("posting_id"), right, "posting_id")) == ["2", "2"]
    flagged = K.flag_matched(left, F.col("posting_id"), right, "posting_id", "hit")
    assert flagged.columns == ["posting_id", "url", "hit"] and flagged.where("hit").count() == 2


def test_new_and_skipped_are_a_partition(spark):
    rng = random.Random(1)
    links = spark.createDataFrame([(f"/cls/{rng.randint(1, 50)}.html" if rng.random() < 0.9 else "/other", i) for i in range(300)],
                                  "url string, i int")
    seen = rows(spark, [str(rng.randint(1, 50)) for _ in range(30)])
    new, skipped = K.split_new(links, seen)
    assert sorted(r["i"] for r in new.unionByName(skipped).collect()) == list(range(300))
    assert all(r["url"][5:-5] in set(ids(seen)) for r in skipped.collect())


def test_dedup_is_idempotent_and_keeps_keyless_rows(spark):
    df = rows(spark, ["a", "b", "a", "", None, "", "b"])
    once = K.dedup(df, "posting_id", ["url"])
    assert sorted((r["posting_id"] or "", r["url"]) for r in once.collect()) == [("", "u3"), ("", "u4"), ("", "u5"), ("a", "u0"), ("b", "u1")]
    assert sorted(map(str, K.dedup(once, "posting_id", ["url"]).collect())) == sorted(map(str, once.collect()))
    assert K.dedup(df.na.fill(""), "posting_id", ["url"], "collapse").count() == 3
    with pytest.raises(ValueError):
        K.dedup(df, "posting_id", ["url"], "other")


def test_dedup_cuts_before_the_shuffle(spark):
    plan = K.dedup(rows(spark, ["a"]), "posting_id", ["url"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_keys_are_split(spark):
    """A third of the rows share one id and more have none: the join splits the hot part."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        key = F.when(i % 3 == 0, "hot").when(i % 11 == 0, "").otherwise(i.cast("string"))
        left = spark.range(0, 300_000, 1, 16).select(key.alias("posting_id"), F.sha2(i.cast("string"), 256).alias("url"), "id")
        right = spark.range(0, 200_000, 1, 8).select(F.when(i % 3 == 1, "hot2").otherwise((i * 2).cast("string")).alias("posting_id"))
        out = K.filter_new(left, right)
        got = out.agg(F.count("*"), F.sum("id")).first()
        plan = out._jdf.queryExecution()
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        taken = {str(x * 2) for x in range(200_000) if x % 3 != 1}
        keep = [x for x in range(300_000) if x % 3 == 0 or x % 11 == 0 or str(x) not in taken]
        assert tuple(got) == (len(keep), sum(keep)) and plan is not None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


NOW = dt.datetime(2025, 7, 10, 12)


def store(spark, data):
    return spark.createDataFrame([(k, "t", "u", at, at, at) for k, at in data],
                                 "posting_id string, title string, url string, scraped_date timestamp, first_scraped timestamp, last_updated timestamp")


def test_upsert_last_write_wins_and_is_idempotent(spark):
    seen = store(spark, [("1", dt.datetime(2025, 7, 1)), ("2", dt.datetime(2025, 7, 2))])
    batch = rows(spark, ["2", "3", "3", ""]).withColumn("title", F.lit("t"))
    new = K.seen_rows(batch, F.lit(NOW), [F.desc("url")])
    out = K.upsert_seen(seen, new)
    assert sorted((r["posting_id"], r["first_scraped"] == NOW) for r in out.collect()) == [("1", False), ("2", True), ("3", True)]
    assert sorted(map(str, K.upsert_seen(out, new).collect())) == sorted(map(str, out.collect()))


def test_purge_is_strict(spark):
    week = dt.timedelta(days=7)
    seen = store(spark, [("old", NOW - week - dt.timedelta(seconds=1)), ("edge", NOW - week), ("new", NOW)])
    assert ids(K.purge_seen(seen, NOW)) == ["edge", "new"]
    assert K.purge_counts(seen, NOW).first().asDict() == {"purged": 1, "kept": 2}
    assert K.seen_stats(seen, NOW).first().asDict() == {"total_tracked_jobs": 3, "recent_jobs_24h": 1}
    assert K.clear_seen(seen).count() == 0 and ids(K.remove_seen(seen, seen.where("posting_id = 'old'"))) == ["edge", "new"]


def test_progress(spark):
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "url string")
    row = K.progress(every, every.where("url = 'a'")).first().asDict()
    assert row == {"total": 3, "processed": 1, "remaining": 2, "progress": 33, "is_complete": False}
    assert K.progress(every.limit(0), every).first()["progress"] == 0


def test_keyed_sides_are_not_cross_joined(spark):
    df = fx_postings(spark, "/root/testdata/sf0.001")
    plan = K.filter_new(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
