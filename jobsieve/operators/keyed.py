"""De-duplication by key, the seen-posting store and joins by key.

Rows without a key never match and are never folded. Key sides are reduced to
distinct keys before they are shuffled. A second join column, a hash of the key,
makes Spark shuffle both sides for the join itself, which lets adaptive execution
split a hot key on the row side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.fields import url_posting_id
from jobsieve.functions.text import blank_to_null, half_up_ratio, trimmed

NO_KEY = "\u0000"


def _first_of_key(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Row number 1 of each key; Spark cuts to one row per key before and after the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup(df: DataFrame, key: str, order: Sequence[str | Column], null_key: str = "keep") -> DataFrame:
    """First row of each key in the given order.

    `null_key='keep'` keeps every row with a NULL or empty key, `'collapse'` treats the
    missing key as one more key. `'keep'` reads its input twice, so hand in a stored or
    cached table where rows are costly to make.
    """
    if null_key == "collapse":
        return _first_of_key(df, key, order)
    if null_key != "keep":
        raise ValueError(f"unknown null_key {null_key!r}")
    has_key = F.coalesce(F.col(key) != "", F.lit(False))
    return _first_of_key(df.where(has_key), key, order).unionByName(df.where(~has_key))


def dedup_any(df: DataFrame, key: str) -> DataFrame:
    """One row of each key when it does not matter which."""
    return df.dropDuplicates([key])


def _row_key(df: DataFrame, key: Column) -> DataFrame:
    """Join columns of the row side. Rows without a key are spread over many values that match nothing."""
    spread = F.concat(F.lit(NO_KEY), F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("string"))
    keyed = df.withColumn("_k", F.coalesce(blank_to_null(key), spread))
    return keyed.withColumn("_h", F.xxhash64("_k"))


def _key_table(keys: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty keys with the join columns."""
    once = keys.select(F.col(key).alias("_k")).where(F.col("_k") != "").distinct()
    return once.withColumn("_h", F.xxhash64("_k"))


def keep_unmatched(df: DataFrame, key: Column, keys: DataFrame, keys_col: str) -> DataFrame:
    """Rows whose key is not among the keys; rows without a key stay."""
    return _row_key(df, key).join(_key_table(keys, keys_col), ["_k", "_h"], "left_anti").drop("_k", "_h")


def keep_matched(df: DataFrame, key: Column, keys: DataFrame, keys_col: str) -> DataFrame:
    """Rows whose key is among the keys."""
    return _row_key(df, key).join(_key_table(keys, keys_col), ["_k", "_h"], "left_semi").drop("_k", "_h")


def flag_matched(df: DataFrame, key: Column, keys: DataFrame, keys_col: str, flag: str) -> DataFrame:
    """All rows with a flag telling whether their key is among the keys."""
    table = _key_table(keys, keys_col).withColumn("_hit", F.lit(True))
    joined = _row_key(df, key).join(table, ["_k", "_h"], "left")
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_h", "_hit")


# --- new against seen ---------------------------------------------------------

def split_new(links: DataFrame, seen: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Links whose posting is not in the store, and the skipped ones. The id is read off the address."""
    key = url_posting_id(F.col(url))
    return keep_unmatched(links, key, seen, "posting_id"), keep_matched(links, key, seen, "posting_id")


def flag_seen(links: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """As `split_new` in one pass: all links with `is_seen`."""
    return flag_matched(links, url_posting_id(F.col(url)), seen, "posting_id", "is_seen")


def export_ids(export: DataFrame) -> DataFrame:
    """Distinct posting ids of an export, without quotes and blanks around them."""
    bare = trimmed(F.regexp_replace("posting_id", '"', "")).alias("posting_id")
    return export.select(bare).where(F.col("posting_id") != "").distinct()


def filter_new(postings: DataFrame, export: DataFrame) -> DataFrame:
    """Postings that the export does not hold. Rows without id stay; nothing is folded within the batch."""
    return keep_unmatched(postings, F.col("posting_id"), export_ids(export), "posting_id")


# --- seen store -----------------------------------------------------------------

def seen_rows(postings: DataFrame, now: Column, order: Sequence[str | Column]) -> DataFrame:
    """Store rows of a batch: the last write of each id wins. Rows without id are not stored."""
    keyed = postings.where(F.coalesce(F.col("posting_id") != "", F.lit(False)))
    last = _first_of_key(keyed, "posting_id", order)
    return last.select("posting_id", "title", "url", now.alias("scraped_date"), now.alias("first_scraped"),
                       now.alias("last_updated"))


def upsert_seen(seen: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Store after a batch: every id of the batch is replaced, also its `first_scraped`.

    `new_rows` holds each id once (see `seen_rows`).
    """
    return keep_unmatched(seen, F.col("posting_id"), new_rows, "posting_id").unionByName(new_rows)


def sightings(df: DataFrame, key: str = "posting_id", ts: str = "scraped_at") -> DataFrame:
    """Ledger of each id: first seen, last seen, times seen."""
    keyed = df.where(F.col(key).cast("string") != "")
    return keyed.groupBy(F.col(key).alias("posting_id")).agg(
        F.min(ts).alias("first_scraped"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("times_seen"))


def merge_sightings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Two ledgers as one."""
    return stored.unionByName(new).groupBy("posting_id").agg(
        F.min("first_scraped").alias("first_scraped"), F.max("last_seen").alias("last_seen"),
        F.sum("times_seen").alias("times_seen"))


def lookup_seen(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """Store record of each asked id (bulk lookup); `found` tells whether there is one. Blank ids match nothing."""
    record = (seen.where(F.col("posting_id") != "").withColumnRenamed("posting_id", "_k")
              .withColumn("_h", F.xxhash64("_k")).withColumn("_found", F.lit(True)))
    out = _row_key(keys, F.col("posting_id")).join(record, ["_k", "_h"], "left")
    return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_k", "_h", "_found")


def has_seen(keys: DataFrame, seen: DataFrame) -> DataFrame:
    """The asked ids that the store holds."""
    return keep_matched(keys, F.col("posting_id"), seen, "posting_id")


def remove_seen(seen: DataFrame, keys: DataFrame) -> DataFrame:
    return keep_unmatched(seen, F.col("posting_id"), keys, "posting_id")


def clear_seen(seen: DataFrame) -> DataFrame:
    """Empty store with the same schema."""
    return seen.limit(0)


def _now(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def purge_seen(seen: DataFrame, now, days: int = 7) -> DataFrame:
    """Store without the ids not updated for more than `days` days; run on every batch."""
    return seen.where(F.col("last_updated") >= _now(now) - F.make_dt_interval(F.lit(days)))


def purge_counts(seen: DataFrame, now, days: int = 7) -> DataFrame:
    """How many ids a purge removes and keeps."""
    old = F.col("last_updated") < _now(now) - F.make_dt_interval(F.lit(days))
    return seen.agg(F.count_if(old).alias("purged"), F.count_if(~old).alias("kept"))


def seen_stats(seen: DataFrame, now, hours: int = 24) -> DataFrame:
    """Number of ids and of those updated within the last day."""
    recent = F.col("last_updated") > _now(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return seen.agg(F.count(F.lit(1)).alias("total_tracked_jobs"), F.count_if(recent).alias("recent_jobs_24h"))


# --- joins and progress ------------------------------------------------------------

def attach_listing(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Listing attributes on extracted postings. `links` hold each address once."""
    side = links.select("url", F.col("is_sponsored").alias("listing_sponsored"),
                        F.coalesce("found_date", F.lit("")).alias("listing_date"), F.xxhash64("url").alias("_h"))
    return postings.withColumn("_h", F.xxhash64("url")).join(side, ["url", "_h"]).drop("_h")


def progress(every: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """One row: total, processed, remaining, whole-number percentage and whether all is done."""
    flagged = flag_matched(every.select(key).distinct(), F.col(key), done, key, "is_done")
    out = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_done").alias("processed"))
    total, processed = F.col("total"), F.col("processed")
    return out.select("total", "processed", (total - processed).alias("remaining"),
                      half_up_ratio(processed, total, 100).alias("progress"),
                      (processed >= total).alias("is_complete"))
