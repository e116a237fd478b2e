"""Queries over the seen store, ledgers, joins by key and de-duplication."""

from pyspark.sql import functions as F

from jobsieve.operators import keyed as K
from jobsieve.operators.classify import with_found_date
from jobsieve.operators.links import dedup_links
from jobsieve.functions import tags
from jobsieve.registry.base import fx_links, fx_postings, query, table

P = ("fx_postings",)
# What earlier exports hold: everything scraped before this day.
CUTOFF = "DATE '1998-01-01'"
EARLIER = f"seen AS (SELECT DISTINCT posting_id FROM fx_postings WHERE scraped_at < {CUTOFF} AND posting_id <> '')"
URL_ID = "regexp_extract(url, 'cls/(\\d+)\\.html', 1)"


def day(text):
    """Start of a day, whatever the session's time zone."""
    return F.expr(f"TIMESTAMP_NTZ '{text} 00:00:00'")


def earlier(spark, sf):
    return fx_postings(spark, sf).where(F.expr(f"scraped_at < {CUTOFF}"))


@query("split_new", f"""
WITH {EARLIER} SELECT url, 'new' AS part FROM fx_postings WHERE {URL_ID} NOT IN (SELECT posting_id FROM seen)
UNION ALL SELECT url, 'skipped' FROM fx_postings WHERE {URL_ID} IN (SELECT posting_id FROM seen)""", P)
def split_new(spark, sf):
    new, skipped = K.split_new(fx_postings(spark, sf).select("url"), earlier(spark, sf))
    return new.withColumn("part", F.lit("new")).unionByName(skipped.withColumn("part", F.lit("skipped")))


@query("flag_seen", f"WITH {EARLIER} SELECT url, {URL_ID} IN (SELECT posting_id FROM seen) AS is_seen FROM fx_postings", P)
def flag_seen(spark, sf):
    return K.flag_seen(fx_postings(spark, sf).select("url"), earlier(spark, sf))


@query("filter_new", f"""
WITH {EARLIER} SELECT url, posting_id, title FROM fx_postings WHERE posting_id = '' OR posting_id NOT IN (SELECT posting_id FROM seen)""", P)
def filter_new(spark, sf):
    return K.filter_new(fx_postings(spark, sf).select("url", "posting_id", "title"), earlier(spark, sf))


@query("export_ids", """SELECT DISTINCT posting_id FROM fx_postings WHERE posting_id <> ''""", P)
def export_ids(spark, sf):
    quoted = fx_postings(spark, sf).withColumn("posting_id", F.concat(F.lit(' "'), "posting_id", F.lit('" ')))
    return K.export_ids(quoted)


def events(spark, sf):
    """Each event as a sighting of a posting; purchases carry no id."""
    e = table(spark, sf, "events")
    key = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.substring("event_type", 1, 2))
    return e.select(F.when(F.col("event_type") == "purchase", "").otherwise(key).alias("posting_id"),
                    F.col("event_type").alias("title"), F.concat(F.lit("/cls/"), F.col("event_id").cast("string")).alias("url"),
                    F.col("ts").alias("scraped_at"), "event_id")


EVENTS = """ev AS (SELECT CASE WHEN event_type = 'purchase' THEN '' ELSE concat(CAST(user_id AS VARCHAR), '-', substring(event_type, 1, 2)) END AS posting_id,
  event_type AS title, '/cls/' || CAST(event_id AS VARCHAR) AS url, ts AS scraped_at, event_id FROM events)"""
STORE = """st AS (SELECT posting_id, title, url, scraped_at AS last_updated FROM ev WHERE posting_id <> ''
  QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at DESC, url) = 1)"""


def store(spark, sf):
    """Store as it stands after all events, each written at its own time."""
    rows = K.dedup(events(spark, sf).where("posting_id <> ''"), "posting_id", [F.desc("scraped_at"), "url"])
    at = F.col("scraped_at")
    return rows.select("posting_id", "title", "url", at.alias("scraped_date"), at.alias("first_scraped"), at.alias("last_updated"))


@query("upsert_seen", f"""
WITH {EVENTS}, old AS (SELECT posting_id, title, url, scraped_at FROM ev WHERE posting_id <> '' AND scraped_at < TIMESTAMP '2024-01-19'
    QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at DESC, url) = 1),
new AS (SELECT posting_id, title, url FROM ev WHERE posting_id <> '' AND scraped_at >= TIMESTAMP '2024-01-19'
    QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at DESC, url) = 1)
SELECT posting_id, title, url, 'old' AS written FROM old WHERE posting_id NOT IN (SELECT posting_id FROM new)
UNION ALL SELECT posting_id, title, url, 'new' FROM new""")
def upsert_seen(spark, sf):
    ev, order = events(spark, sf), [F.desc("scraped_at"), "url"]
    old = K.seen_rows(ev.where("scraped_at < TIMESTAMP_NTZ '2024-01-19'"), day("2024-01-19"), order)
    new = K.seen_rows(ev.where("scraped_at >= TIMESTAMP_NTZ '2024-01-19'"), day("2024-01-31"), order)
    written = F.when(F.col("last_updated") == day("2024-01-31"), "new").otherwise("old")
    return K.upsert_seen(old, new).select("posting_id", "title", "url", written.alias("written"))


LEDGER = "SELECT posting_id, CAST(min(scraped_at) AS VARCHAR) AS first_scraped, CAST(max(scraped_at) AS VARCHAR) AS last_seen, count(*) AS times_seen FROM ev WHERE posting_id <> '' GROUP BY 1"


def as_text(ledger):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.date_format(c, fmt), "0+$", ""), r"\.$", "")
    return ledger.withColumn("first_scraped", tidy("first_scraped")).withColumn("last_seen", tidy("last_seen"))


@query("sightings", f"WITH {EVENTS} {LEDGER}")
def sightings(spark, sf):
    return as_text(K.sightings(events(spark, sf)))


@query("merge_sightings", f"WITH {EVENTS} {LEDGER}")
def merge_sightings(spark, sf):
    ev = events(spark, sf)
    first = K.sightings(ev.where("scraped_at < TIMESTAMP_NTZ '2024-01-15'"))
    return as_text(K.merge_sightings(first, K.sightings(ev.where("scraped_at >= TIMESTAMP_NTZ '2024-01-15'"))))


@query("purge_seen", f"WITH {EVENTS}, {STORE} SELECT posting_id, url FROM st WHERE last_updated >= TIMESTAMP '2024-01-21'")
def purge_seen(spark, sf):
    return K.purge_seen(store(spark, sf), day("2024-01-28")).select("posting_id", "url")


@query("purge_counts", f"""
WITH {EVENTS}, {STORE} SELECT count(*) FILTER (WHERE last_updated < TIMESTAMP '2024-01-28') AS purged,
  count(*) FILTER (WHERE last_updated >= TIMESTAMP '2024-01-28') AS kept FROM st""")
def purge_counts(spark, sf):
    return K.purge_counts(store(spark, sf), day("2024-02-04"))


@query("seen_stats", f"""
WITH {EVENTS}, {STORE} SELECT count(*) AS total_tracked_jobs, count(*) FILTER (WHERE last_updated > TIMESTAMP '2024-01-27') AS recent_jobs_24h FROM st""")
def seen_stats(spark, sf):
    return K.seen_stats(store(spark, sf), day("2024-01-28"))


ASKED = "asked AS (SELECT DISTINCT concat(CAST(user_id AS VARCHAR), '-', substring(event_type, 1, 2)) AS posting_id FROM events)"


def asked(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.substring("event_type", 1, 2)).alias("posting_id")).distinct()


@query("lookup_seen", f"""
WITH {EVENTS}, {STORE}, {ASKED} SELECT posting_id, title, url, url IS NOT NULL AS found FROM asked LEFT JOIN st USING (posting_id)""")
def lookup_seen(spark, sf):
    return K.lookup_seen(asked(spark, sf), store(spark, sf)).select("posting_id", "title", "url", "found")


@query("has_seen", f"WITH {EVENTS}, {STORE}, {ASKED} SELECT posting_id FROM asked WHERE posting_id IN (SELECT posting_id FROM st)")
def has_seen(spark, sf):
    return K.has_seen(asked(spark, sf), store(spark, sf))


@query("remove_seen", f"""
WITH {EVENTS}, {STORE} SELECT posting_id, url FROM st WHERE posting_id NOT IN (SELECT posting_id FROM ev WHERE scraped_at >= TIMESTAMP '2024-01-25')""")
def remove_seen(spark, sf):
    gone = events(spark, sf).where("scraped_at >= TIMESTAMP_NTZ '2024-01-25'")
    return K.remove_seen(store(spark, sf), gone).select("posting_id", "url")


@query("dedup_keep_null", f"""
WITH {EVENTS} SELECT url, posting_id FROM ev WHERE posting_id = '' UNION ALL
SELECT url, posting_id FROM (SELECT * FROM ev WHERE posting_id <> '' QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at, url) = 1)""")
def dedup_keep_null(spark, sf):
    return K.dedup(events(spark, sf), "posting_id", ["scraped_at", "url"]).select("url", "posting_id")


@query("dedup_collapse_null", f"""
WITH {EVENTS} SELECT url, posting_id FROM ev QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY scraped_at, url) = 1""")
def dedup_collapse_null(spark, sf):
    return K.dedup(events(spark, sf), "posting_id", ["scraped_at", "url"], "collapse").select("url", "posting_id")


@query("dedup_any", f"WITH {EVENTS} SELECT DISTINCT posting_id FROM ev")
def dedup_any(spark, sf):
    return K.dedup_any(events(spark, sf), "posting_id").select("posting_id")


@query("attach_listing", """
WITH l AS (SELECT 'https://jobs.example.com' || href AS url, suffix(parent_text, 'Sponsored') AS sp, parent_text,
    row_number() OVER (PARTITION BY href ORDER BY page_no, pos) AS rn FROM fx_links)
SELECT p.url, p.title, sp AS listing_sponsored, coalesce(nullif(regexp_extract(parent_text, '\\d{1,2}/\\d{1,2}/\\d{4}', 0), ''),
  CASE WHEN contains(parent_text, 'PM - ') THEN regexp_extract(parent_text, 'Tue, .*$', 0) ELSE '' END) AS listing_date
FROM fx_postings p JOIN l ON l.url = p.url AND rn = 1""", ("fx_postings", "fx_links"))
def attach_listing(spark, sf):
    links = fx_links(spark, sf).withColumn("url", F.concat(F.lit("https://jobs.example.com"), "href"))
    first = dedup_links(links).withColumn("is_sponsored", tags.is_sponsored(F.col("parent_text")))
    return K.attach_listing(fx_postings(spark, sf).select("url", "title"), with_found_date(first))


@query("step_progress", f"""
WITH {EARLIER}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE scraped_at < {CUTOFF}) AS processed FROM fx_postings)
SELECT total, processed, total - processed AS remaining, CAST((200 * processed + total) // (2 * total) AS BIGINT) AS progress,
  processed >= total AS is_complete FROM c""", P)
def step_progress(spark, sf):
    return K.progress(fx_postings(spark, sf), earlier(spark, sf))
