"""Queries that write the tables' postings to files and read them back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobsieve.functions.text import iso_utc
from jobsieve.operators import keyed as K
from jobsieve.registry.base import fx_links, fx_postings, query, table
from jobsieve.registry.store import CUTOFF, EARLIER, EVENTS, STORE, earlier, events, store
from jobsieve.schema import EXPORT_HEADERS, POSTING, POSTING_COLUMNS
from jobsieve.session import scratch_path
from jobsieve.sources import exports as E
from jobsieve.sources import json_results as J
from jobsieve.sources import store as S

P = ("fx_postings",)
NOTE = "concat(description, chr(10), 'Say \"hello\", then ', chr(10), repeat(concat(title, ' '), CAST(seq % 80 AS INT)))"
FULL = f"""full_rows AS (SELECT title, salary, contact, email, location, posting_id, '' AS posted_date, CASE WHEN seq % 2 = 0 THEN 'Jobs' ELSE '' END AS category,
  employment_type, '' AS company, '' AS requirements, ' padded ' AS benefits, {NOTE} AS description, url, CAST(scraped_at AS VARCHAR) AS scraped_at,
  is_sponsored, strftime(scraped_at, '%Y-%m-01') AS export_date FROM fx_postings)"""


def full_rows(spark, sf):
    text = fx_postings(spark, sf).withColumns({
        "posted_date": F.lit(""), "category": F.expr("CASE WHEN seq % 2 = 0 THEN 'Jobs' ELSE '' END"), "company": F.lit(""),
        "requirements": F.lit(""), "benefits": F.lit(" padded "), "description": F.expr(NOTE),
        "export_date": F.date_format("scraped_at", "yyyy-MM-01")})
    return text.withColumn("scraped_at", F.col("scraped_at").cast("string")).select(*POSTING_COLUMNS, "export_date")


ROWS = f"WITH {FULL} SELECT * EXCLUDE (export_date) REPLACE (substring(description, 1, 1000) AS description) FROM full_rows"


@query("csv_roundtrip", ROWS, P)
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    E.write_postings_csv(full_rows(spark, sf), path)
    return E.read_postings_csv(spark, path)


@query("csv_fifteen_columns", f"SELECT * REPLACE ('No' AS is_sponsored) FROM ({ROWS})", P)
def csv_fifteen_columns(spark, sf):
    path = scratch_path(spark, "csv15")
    E.write_postings_csv(full_rows(spark, sf), path, POSTING_COLUMNS[:-1])
    return E.read_postings_csv(spark, path)


def dated(spark, sf):
    """Monthly export folders of all postings."""
    path = scratch_path(spark, "exports")
    E.write_postings_csv(full_rows(spark, sf).repartition("export_date"), path, partition_by=("export_date",))
    return path


@query("latest_export", f"WITH {FULL} SELECT url, posting_id, title FROM full_rows WHERE export_date = (SELECT max(export_date) FROM full_rows)", P)
def latest_export(spark, sf):
    return E.latest_export(E.read_postings_csv(spark, dated(spark, sf))).select("url", "posting_id", "title")


@query("export_for_date", f"WITH {FULL} SELECT url, posting_id, title FROM full_rows WHERE export_date = '1999-05-01'", P)
def export_for_date(spark, sf):
    return E.export_for(E.read_postings_csv(spark, dated(spark, sf)), "1999-05-01").select("url", "posting_id", "title")


@query("list_exports", f"WITH {FULL} SELECT export_date AS date, CAST(count(*) AS BIGINT) AS job_count FROM full_rows GROUP BY 1", P)
def list_exports(spark, sf):
    catalog = E.list_exports(spark, dated(spark, sf)).where(F.col("size_kb") > 0)
    return catalog.groupBy("date").agg(F.sum("job_count").alias("job_count"))


# Bytes of a row as the sink writes it: every field in quotes, quotes doubled, commas between, a line break behind.
CSV_BYTES = " + ".join(f"strlen(replace({c}, '\"', '\"\"')) + 3" for c in POSTING_COLUMNS if c != "description") + (
    " + strlen(replace(substring(description, 1, 1000), '\"', '\"\"')) + 3")
HEADER_BYTES = sum(len(h) + 3 for h in EXPORT_HEADERS.values())


@query("export_catalog", f"""
WITH {FULL}, c AS (SELECT export_date AS date, count(*) AS job_count, round(({HEADER_BYTES} + sum({CSV_BYTES})) / 1024, 2) AS size_kb FROM full_rows GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY date DESC) AS INT) AS place, date, CAST(job_count AS BIGINT) AS job_count, size_kb, true AS is_csv FROM c""", P)
def export_catalog(spark, sf):
    """One file for each day, newest first, with its size."""
    listed = E.list_exports(spark, dated(spark, sf)).withColumn("_no", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_no"))
    return listed.select(place.alias("place"), "date", "job_count", "size_kb", F.endswith("filename", F.lit(".csv")).alias("is_csv"))


@query("export_folders", """
SELECT url, 'quick_auto' AS mode, '2025-07-01' AS export_date, 'regular_jobs_quick_auto_2025-07-01.csv' AS name FROM fx_postings WHERE seq % 2 = 0
UNION ALL SELECT url, 'full', '2025-07-02', 'regular_jobs_2025-07-02.csv' FROM fx_postings WHERE seq % 2 = 1""", P)
def export_folders(spark, sf):
    rows = fx_postings(spark, sf).select("url", "seq")
    out = []
    for odd, date, words in ((0, "2025-07-01", True), (1, "2025-07-02", False)):
        part = E.with_export_folders(rows.where(F.col("seq") % 2 == odd), date, quick=words, auto=words)
        out.append(part.select("url", "mode", "export_date", F.lit(E.export_name(date, words, words)).alias("name")))
    return out[0].unionByName(out[1])


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", iso_utc(F.col("ts")).alias("at"))


@query("seen_log_expiry", f"""
WITH {EVENTS} SELECT posting_id, url, CAST(3 AS BIGINT) AS folders FROM ev WHERE posting_id <> '' AND scraped_at >= TIMESTAMP '2024-01-12'
  AND scraped_at < TIMESTAMP '2024-01-27' QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at DESC, url) = 1""")
def seen_log_expiry(spark, sf):
    """Eight batches of three days; one is repeated, the closed days are compacted, the first four days expire."""
    root, ev = scratch_path(spark, "seen-log"), events(spark, sf).where("posting_id <> ''")
    at = F.col("scraped_at").cast("timestamp")

    def write(batch, low, high, day):
        part = ev.where(f"scraped_at >= TIMESTAMP_NTZ '{low}' AND scraped_at < TIMESTAMP_NTZ '{high}'")
        once = K.dedup(part, "posting_id", [F.desc("scraped_at"), "url"])
        rows = once.select("posting_id", "title", "url", at.alias("scraped_date"), at.alias("first_scraped"), at.alias("last_updated"))
        S.append_seen_log(rows, root, day, batch)

    steps = [("2024-01-01", "2024-01-06"), ("2024-01-06", "2024-01-12"), ("2024-01-12", "2024-01-15"), ("2024-01-15", "2024-01-18"),
             ("2024-01-18", "2024-01-21"), ("2024-01-21", "2024-01-24"), ("2024-01-24", "2024-01-27")]
    days = ("2024-01-05", "2024-01-05", "2024-01-14", "2024-01-14", "2024-01-20", "2024-01-20", "2024-01-26")
    for i, (step, day) in enumerate(zip(steps, days)):
        write(i, *step, day)
    write(2, *steps[2], "2024-01-20")               # a batch that is repeated on a later day
    S.compact_seen_log(spark, root, "2024-01-26")
    S.expire_seen_log(spark, root, "2024-01-12")
    S.vacuum_seen_log(spark, root)
    folders = F.lit(len(S.live_folders(spark, root))).cast("bigint")
    return S.current_seen(S.read_seen_log(spark, root)).select("posting_id", "url", folders.alias("folders"))


@query("append_export", f"""
WITH {EARLIER} SELECT url, posting_id FROM fx_postings WHERE scraped_at < {CUTOFF}
UNION ALL SELECT url, posting_id FROM fx_postings WHERE posting_id = '' OR posting_id NOT IN (SELECT posting_id FROM seen)""", P)
def append_export(spark, sf):
    root = scratch_path(spark, "append")
    E.append_export(earlier(spark, sf).select("url", "posting_id"), root, "2025-07-01")
    stored = spark.read.parquet(root)
    E.append_export(fx_postings(spark, sf).select("url", "posting_id"), root, "2025-07-01", stored)
    return spark.read.parquet(root).select("url", "posting_id")


@query("write_batches", """
SELECT url, CAST((row_number() OVER (ORDER BY seq) - 1) // 2000 + 1 AS BIGINT) AS batch_no FROM fx_postings""", P)
def write_batches(spark, sf):
    root = scratch_path(spark, "batches")
    E.write_batches(fx_postings(spark, sf).select("url", "seq"), root, ["seq"], 2000)
    return spark.read.parquet(root).select("url", F.col("batch_no").cast("bigint").alias("batch_no"))


@query("seen_store_versions", f"WITH {EVENTS}, {STORE} SELECT posting_id, url FROM st")
def seen_store_versions(spark, sf):
    root = scratch_path(spark, "seen")
    full = store(spark, sf)
    S.write_seen(full.where("last_updated < TIMESTAMP_NTZ '2024-01-20'"), root)
    S.write_seen(S.read_seen(spark, root).unionByName(full.where("last_updated >= TIMESTAMP_NTZ '2024-01-20'")), root)
    return S.read_seen(spark, root).select("posting_id", "url")


@query("seen_log", f"WITH {EVENTS}, {STORE} SELECT posting_id, url FROM st")
def seen_log(spark, sf):
    root, ev = scratch_path(spark, "seen-log"), events(spark, sf).where("posting_id <> ''")
    at = F.col("scraped_at").cast("timestamp")
    cuts = ("2024-01-01", "2024-01-12", "2024-01-25", "2024-03-01")
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = ev.where(f"scraped_at >= TIMESTAMP_NTZ '{low}' AND scraped_at < TIMESTAMP_NTZ '{high}'")
        once = K.dedup(part, "posting_id", [F.desc("scraped_at"), "url"])
        rows = once.select("posting_id", "title", "url", at.alias("scraped_date"), at.alias("first_scraped"), at.alias("last_updated"))
        S.append_seen_log(rows, root, low, i)
    return S.current_seen(S.read_seen_log(spark, root)).select("posting_id", "url")


@query("json_roundtrip", f"WITH {FULL} SELECT * EXCLUDE (export_date) FROM full_rows", P)
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    J.write_json(full_rows(spark, sf).drop("export_date"), path)
    return spark.read.schema(POSTING).json(path)


@query("response_json", """
SELECT 'link ' || CAST(pos AS VARCHAR) AS title, href AS url, CASE WHEN contains(href, '/cls/') THEN 'job_detail' ELSE 'category' END AS type,
  'page ' || CAST(page_no AS VARCHAR) AS location FROM fx_links""", ("fx_links",))
def response_json(spark, sf):
    path = scratch_path(spark, "responses")
    row = F.struct(F.concat(F.lit("link "), F.col("pos").cast("string")).alias("title"), F.col("href").alias("url"),
                   F.when(F.contains("href", F.lit("/cls/")), "job_detail").otherwise("category").alias("type"),
                   F.concat(F.lit("page "), F.col("page_no").cast("string")).alias("location"))
    # A listing page holds at most 100 links, so a response does too.
    pages = fx_links(spark, sf).groupBy("page_no").agg(F.collect_list(row).alias("data"))
    pages.select(F.lit(True).alias("success"), F.size("data").alias("count"), "data").write.json(path)
    return J.read_response_json(spark, path, lines=True)[0].select("title", "url", "type", "location")
