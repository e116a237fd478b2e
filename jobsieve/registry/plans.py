"""Queries that run whole plans: a day's run from listing pages, the listing report, questions to an export."""

from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.plans import daily, export_report
from jobsieve.plans.listing_report import listing_report, posting_link_table
from jobsieve.registry.base import BASE, OWN_DOMAIN, STAMP, fx_links, fx_posting_text, query
from jobsieve.registry.extraction import CHALLENGE
from jobsieve.registry.files import FULL, dated
from jobsieve.registry.links import CITIES, COUNTS, LINKED, POSTING, SPONSORED_PCT, STRICT, TOTALS, VISITED, city_links
from jobsieve.registry.links import STAMP as LINK_STAMP
from jobsieve.registry.store import EARLIER, earlier
from jobsieve.registry.streams import ID, PAGE

V = ("fx_links",)
FILLED = "page_no % 41 <> 40"


def listing_pages(spark, sf, filled):
    """HTML of the listing pages: an item for every link, its text beside the anchor; some pages have lost their links."""
    item = F.concat(F.lit("<li><a href='"), "href", F.lit("'></a> <b>"), "parent_text", F.lit("</b></li>"))
    links = fx_links(spark, sf)
    # A listing page has at most 100 links.
    pages = links.groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
    body = F.when(F.expr(filled), F.array_join(F.transform("items", lambda x: x["item"]), "\\n")).otherwise("none")
    return pages.select("page_no", F.concat(F.lit("<html><body><ul>"), body, F.lit("</ul></body></html>")).alias("html"))


WALK = f"""l AS (SELECT page_no, pos, href, suffix(trim(parent_text), 'Sponsored') AS is_sponsored FROM fx_links
  WHERE {FILLED} AND {POSTING} AND trim(parent_text) <> ''),
stop AS (SELECT min(page_no) AS n FROM (SELECT DISTINCT page_no FROM fx_links) a WHERE page_no NOT IN (SELECT page_no FROM l)),
w AS (SELECT * FROM l WHERE page_no < coalesce((SELECT n FROM stop), 9223372036854775807)),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY is_sponsored, href ORDER BY page_no, pos) = 1)"""


@query("daily_links", f"WITH {WALK} SELECT page_no, '{BASE}' || href AS url, is_sponsored FROM r", V)
def daily_links(spark, sf):
    """Links of a walk that ends at the first page without any, sponsored ones too."""
    links = daily.regular_links(listing_pages(spark, sf, FILLED), BASE, stop_at_empty=True, sponsored=True)
    return links.select("page_no", "url", "is_sponsored")


def _run(spark, sf):
    links = daily.regular_links(listing_pages(spark, sf, FILLED), BASE, stop_at_empty=True)
    pages = fx_posting_text(spark, sf).select(F.col("seq").alias("page_id"), "url", F.expr(PAGE).alias("html"))
    seen = earlier(spark, sf)
    return daily.daily_run(links, pages, seen, seen.limit(0), P.primary_profile(OWN_DOMAIN), scraped_at=STAMP)


DAY = f"""{EARLIER}, {WALK}, d AS (SELECT '{BASE}' || href AS url, regexp_extract(href, 'cls/(\\d+)\\.html', 1) IN (SELECT posting_id FROM seen) AS known FROM r WHERE NOT is_sponsored),
x AS (SELECT t.url, title, {ID.replace('url', 't.url')} AS posting_id FROM d JOIN fx_posting_text t ON t.url = d.url AND NOT known WHERE NOT {CHALLENGE})"""
DAY_VIEWS = ("fx_links", "fx_postings", "fx_posting_text")


@query("daily_run", f"WITH {DAY} SELECT * FROM x", DAY_VIEWS)
def daily_run(spark, sf):
    """New postings of a day, from the listing pages' HTML to the records."""
    return _run(spark, sf).new_postings.select("url", "title", "posting_id")


@query("daily_summary", f"""
WITH {DAY}, n AS (SELECT (SELECT count(*) FROM d WHERE NOT known) AS new_jobs_found, (SELECT count(*) FROM d WHERE known) AS already_seen,
  (SELECT count(*) FROM x) AS extracted)
SELECT *, new_jobs_found - extracted AS failed, CASE WHEN new_jobs_found = 0 THEN 0
  ELSE CAST((200 * extracted + new_jobs_found) // (2 * new_jobs_found) AS BIGINT) END AS success_rate FROM n""", DAY_VIEWS)
def daily_summary(spark, sf):
    return _run(spark, sf).summary()


# --- listing report ---------------------------------------------------------------

REPORT = f"c AS (SELECT page_no, pos, href, parent_text, {STRICT} AS link_class FROM fx_links WHERE {POSTING} AND {LINKED})"


def report(spark, sf):
    pages = listing_pages(spark, sf, LINKED)
    return listing_report(posting_link_table(pages, BASE), pages)


@query("listing_report_pages", f"""
WITH {REPORT}, {VISITED}, n AS (SELECT page_no, {COUNTS} FROM c GROUP BY 1), g AS (SELECT page_no, coalesce(total, 0) AS total,
  coalesce(sponsored, 0) AS sponsored, coalesce(regular, 0) AS regular, coalesce(unknown, 0) AS unknown FROM v LEFT JOIN n USING (page_no))
SELECT *, {SPONSORED_PCT} AS sponsored_pct FROM g""", V)
def listing_report_pages(spark, sf):
    return report(spark, sf).page_breakdown


@query("listing_report_totals", f"WITH {TOTALS} SELECT * FROM t", V)
def listing_report_totals(spark, sf):
    return report(spark, sf).totals


@query("listing_report_verdict", f"""
WITH {TOTALS} SELECT CASE WHEN classified_pct > 95 THEN 'Excellent' WHEN classified_pct > 85 THEN 'Good' ELSE 'Needs improvement' END AS accuracy,
  sponsored > 0 AS some_sponsored, unknown > 0 AS some_unknown FROM t""", V)
def listing_report_verdict(spark, sf):
    verdict = report(spark, sf).verdict
    return verdict.select("accuracy", F.startswith("sponsored_detection", F.lit("Working")).alias("some_sponsored"),
                          F.endswith("unknown_jobs", F.lit("pattern review")).alias("some_unknown"))


@query("listing_report_endings", f"""
WITH {REPORT}, e AS (SELECT link_class, CASE WHEN link_class = 'sponsored' THEN right(trim(parent_text), 20)
  WHEN link_class = 'regular' THEN nullif(regexp_extract(trim(parent_text), '\\d+ \\w+ ago$', 0), '') END AS ending FROM c)
SELECT link_class, ending, count(*) AS n FROM e WHERE ending IS NOT NULL GROUP BY 1, 2""", V)
def listing_report_endings(spark, sf):
    return report(spark, sf).endings


@query("listing_report_samples", f"""
WITH {REPORT}, u AS (SELECT page_no, pos, right(trim(parent_text), 50) AS sample FROM c WHERE link_class = 'unknown'),
p AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY pos) - 1 AS no FROM u),
f AS (SELECT * FROM p WHERE no < 10), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sample ORDER BY page_no, pos) = 1)
SELECT page_no, sample FROM d ORDER BY page_no, pos LIMIT 20""", V)
def listing_report_samples(spark, sf):
    return report(spark, sf).unknown_samples.select("page_no", "sample")


@query("listing_report_details", f"""
WITH {REPORT} SELECT page_no, '' AS title, '{BASE}' || href AS url, link_class, substring(trim(parent_text), 1, 120) AS parent_text,
  suffix(trim(parent_text), 'Sponsored') AS is_sponsored, regexp_matches(trim(parent_text), '{LINK_STAMP}') AS has_timestamp FROM c""", V)
def listing_report_details(spark, sf):
    return report(spark, sf).detailed.drop("pos")


# --- questions to an export ---------------------------------------------------------

MONTH = f"{FULL}, m AS (SELECT * REPLACE (substring(description, 1, 1000) AS description) FROM full_rows WHERE export_date = '1997-05-01')"
HIT = """(contains(lower(title), 'engineer') OR contains(lower(description), 'engineer') OR contains(lower(location), 'engineer'))
  AND contains(lower(location), 'a') AND (trim(salary) = '' OR TRY_CAST(nullif(regexp_replace(salary, '[^0-9]', '', 'g'), '') AS BIGINT) >= 2000)"""


def _asked(spark, sf):
    from jobsieve.sources.exports import read_postings_csv

    return export_report.jobs(read_postings_csv(spark, dated(spark, sf)), "1997-05-01", "engineer", "a", 2000)


@query("export_query", f"WITH {MONTH} SELECT url, title, salary, location FROM m WHERE {HIT}", ("fx_postings",))
def export_query(spark, sf):
    return _asked(spark, sf)[0].select("url", "title", "salary", "location")


@query("export_query_info", f"""
WITH {MONTH} SELECT count(*) AS total_rows, count(*) FILTER (WHERE {HIT}) AS matched_rows, 'engineer' AS search,
  CAST(1 AS BIGINT) AS files, true AS has_size FROM m""", ("fx_postings",))
def export_query_info(spark, sf):
    info = _asked(spark, sf)[1]
    return info.select("total_rows", "matched_rows", "search", "files",
                       (F.col("size_kb").isNotNull() & F.col("last_modified").isNotNull()).alias("has_size"))


# --- cities --------------------------------------------------------------------------

CITY_NO = "CASE page_no % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END"


@query("city_listing_unique", f"""
WITH l AS (SELECT page_no, pos, href, {CITY_NO} AS c, nullif(regexp_extract(href, '/cls/(\\d+)', 1), '') AS job_id FROM fx_links
  WHERE contains(href, '/cls/')),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY c, href ORDER BY page_no, pos) = 1),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY c, page_no, pos) = 1)
SELECT page_no AS page_id, pos, '{BASE}' || href AS url, job_id FROM u ORDER BY c, page_no, pos LIMIT 500""", V)
def city_listing_unique(spark, sf):
    """Each job once over all cities, the first five hundred."""
    from jobsieve.operators.links import city_listing

    return city_listing(city_links(spark, sf), CITIES, BASE, unique=True, limit=500).select("page_id", "pos", "url", "job_id")
