"""Queries over listing links and page snapshots."""

from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.elements import Selector, page_parts
from jobsieve.operators import classify as C
from jobsieve.operators import links as L
from jobsieve.operators.extract import category_records, computed_once, with_challenge_flag, with_extraction_ok, with_page_text
from jobsieve.plans.listing_report import listing_report
from jobsieve.registry.base import STAMP as NOW
from jobsieve.registry.base import BASE, OWN_DOMAIN, fx_links, fx_posting_text, query, table
from jobsieve.session import spread

V = ("fx_links",)
STAMP = "\\w{3}, \\w{3} \\d{1,2}, \\d{4}, \\d{1,2}:\\d{2}:\\d{2} [AP]M - (?:\\d+ \\w+ ago|an hour ago|a day ago)$"
POSTING = "contains(href, '/cls/') AND contains(href, '.html') AND regexp_matches(href, '\\d{8}')"
STRICT = f"CASE WHEN suffix(trim(parent_text), 'Sponsored') THEN 'sponsored' WHEN regexp_matches(trim(parent_text), '{STAMP}') THEN 'regular' ELSE 'unknown' END"
STRICT_LINKS = f"c AS (SELECT page_no, pos, href, parent_text, {STRICT} AS link_class FROM fx_links WHERE {POSTING})"


def strict_links(spark, sf):
    return C.classify_links(L.posting_links(fx_links(spark, sf)), "strict")


@query("classify_strict", f"WITH {STRICT_LINKS} SELECT page_no, pos, link_class FROM c", V)
def classify_strict(spark, sf):
    return strict_links(spark, sf).select("page_no", "pos", "link_class")


@query("classify_lenient", f"""
SELECT page_no, pos, CASE WHEN suffix(trim(parent_text), 'Sponsored') THEN 'sponsored' ELSE 'regular' END AS link_class
FROM fx_links WHERE {POSTING} AND trim(parent_text) <> ''""", V)
def classify_lenient(spark, sf):
    return C.classify_links(L.posting_links(fx_links(spark, sf)), "lenient").select("page_no", "pos", "link_class")


@query("found_date", f"""
WITH d AS (SELECT page_no, pos, coalesce(
  nullif(regexp_extract(parent_text, '{STAMP}', 0), ''), nullif(regexp_extract(parent_text, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}', 0), ''),
  nullif(regexp_extract(parent_text, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}', 0), ''), nullif(regexp_extract(parent_text, '(?i)\\d+ hours? ago', 0), ''),
  nullif(regexp_extract(parent_text, '(?i)\\d+ days? ago', 0), ''), nullif(regexp_extract(parent_text, '(?i)(?:today|yesterday)', 0), ''),
  nullif(regexp_extract(parent_text, '(?i)\\w+ \\d{{1,2}}, \\d{{4}}', 0), ''), nullif(regexp_extract(parent_text, '\\d{{2}}:\\d{{2}}', 0), '')) AS found_date
  FROM fx_links)
SELECT page_no, pos, found_date, found_date IS NOT NULL AS has_date FROM d""", V)
def found_date(spark, sf):
    return C.with_found_date(fx_links(spark, sf)).select("page_no", "pos", "found_date", "has_date")


# Every seventh listing page has lost its links; it is visited all the same.
LINKED = "page_no % 7 <> 3"
VISITED = "v AS (SELECT DISTINCT page_no FROM fx_links)"
COUNTS = """count(*) AS total, count(*) FILTER (WHERE link_class = 'sponsored') AS sponsored,
  count(*) FILTER (WHERE link_class = 'regular') AS regular, count(*) FILTER (WHERE link_class = 'unknown') AS unknown"""
PCT = "CAST((2000 * ({a}) + ({b})) // (2 * ({b})) AS BIGINT) / 10.0::DOUBLE"


COUNTED = f"""{STRICT_LINKS}, {VISITED}, n AS (SELECT page_no, {COUNTS} FROM c WHERE {LINKED} GROUP BY 1),
g AS (SELECT page_no, coalesce(total, 0) AS total, coalesce(sponsored, 0) AS sponsored, coalesce(regular, 0) AS regular,
  coalesce(unknown, 0) AS unknown FROM v LEFT JOIN n USING (page_no))"""
SHARE = "CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE {share} END"
SPONSORED_PCT = SHARE.format(share=PCT.format(a="sponsored", b="total"))


def visited(spark, sf):
    """Links of the pages that have any, and all pages."""
    links = fx_links(spark, sf)
    return C.classify_links(L.posting_links(links.where(LINKED)), "strict"), links.select("page_no").distinct()


@query("page_breakdown", f"WITH {COUNTED} SELECT *, {SPONSORED_PCT} AS sponsored_pct FROM g", V)
def page_breakdown(spark, sf):
    return C.page_breakdown(*visited(spark, sf))


@query("breakdown_with_total", f"""
WITH {COUNTED}, r AS (SELECT page_no, sum(total)::BIGINT AS total, sum(sponsored)::BIGINT AS sponsored,
  sum(regular)::BIGINT AS regular, sum(unknown)::BIGINT AS unknown FROM g GROUP BY ROLLUP (page_no))
SELECT *, {SPONSORED_PCT} AS sponsored_pct FROM r""", V)
def breakdown_with_total(spark, sf):
    return C.breakdown_with_total(*visited(spark, sf))


TOTALS = f"""{COUNTED}, s AS (SELECT count(*) AS pages_analyzed, sum(total)::BIGINT AS total, sum(sponsored)::BIGINT AS sponsored,
  sum(regular)::BIGINT AS regular, sum(unknown)::BIGINT AS unknown FROM g),
t AS (SELECT *, {SHARE.format(share=PCT.format(a='sponsored + regular', b='total'))} AS classified_pct FROM s)"""


@query("class_totals", f"WITH {TOTALS} SELECT * FROM t", V)
def class_totals(spark, sf):
    return C.class_totals(*visited(spark, sf))


@query("quality_band", f"""
WITH {TOTALS} SELECT *,
  CASE WHEN sponsored > 0 THEN '{P.REPORT_SPONSORED[0]}' ELSE '{P.REPORT_SPONSORED[1]}' END AS sponsored_detection,
  CASE WHEN regular > 0 THEN '{P.REPORT_REGULAR[0]}' ELSE '{P.REPORT_REGULAR[1]}' END AS regular_detection,
  CASE WHEN classified_pct > 95 THEN 'Excellent' WHEN classified_pct > 85 THEN 'Good' ELSE 'Needs improvement' END AS accuracy,
  CASE WHEN unknown > 0 THEN CAST(unknown AS VARCHAR) || '{P.REPORT_UNKNOWN[0]}' ELSE '{P.REPORT_UNKNOWN[1]}' END AS unknown_jobs
FROM t""", V)
def quality_band(spark, sf):
    return C.quality_band(C.class_totals(*visited(spark, sf)))


@query("ending_patterns", f"""
WITH {STRICT_LINKS}, e AS (SELECT link_class, CASE WHEN link_class = 'sponsored' THEN right(trim(parent_text), 20)
  WHEN link_class = 'regular' THEN nullif(regexp_extract(trim(parent_text), '\\d+ \\w+ ago$', 0), '') END AS ending FROM c)
SELECT link_class, ending, count(*) AS n FROM e WHERE ending IS NOT NULL GROUP BY 1, 2""", V)
def ending_patterns(spark, sf):
    return C.ending_patterns(strict_links(spark, sf))


UNKNOWN_TEXT = "CASE WHEN parent_text = '' THEN concat('Blank at ', CAST(pos AS STRING)) ELSE parent_text END"


@query("unknown_samples", f"""
WITH t AS (SELECT page_no, pos, href, {UNKNOWN_TEXT} AS parent_text FROM fx_links),
c AS (SELECT page_no, pos, {STRICT} AS link_class, right(trim(parent_text), 50) AS sample FROM t WHERE {POSTING}),
f AS (SELECT * FROM c WHERE link_class = 'unknown' QUALIFY row_number() OVER (PARTITION BY page_no ORDER BY pos) <= 10),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY sample ORDER BY page_no, pos) = 1)
SELECT page_no, pos, sample FROM d ORDER BY page_no, pos LIMIT 20""", V)
def unknown_samples(spark, sf):
    texts = fx_links(spark, sf).withColumn("parent_text", F.expr(UNKNOWN_TEXT))
    return C.unknown_samples(C.classify_links(L.posting_links(texts), "strict"))


@query("detailed_links", f"""
WITH {STRICT_LINKS} SELECT page_no, pos, substring(parent_text || ' on page ' || CAST(page_no AS VARCHAR), 1, 80) AS title, href AS url, link_class,
  substring(trim(parent_text), 1, 120) AS parent_text, suffix(trim(parent_text), 'Sponsored') AS is_sponsored,
  regexp_matches(trim(parent_text), '{STAMP}') AS has_timestamp FROM c""", V)
def detailed_links(spark, sf):
    titled = strict_links(spark, sf).withColumn(
        "title", F.concat("parent_text", F.lit(" on page "), F.col("page_no").cast("string")))
    return C.detailed_links(titled, url="href")


@query("dedup_links", """
SELECT page_no, pos, href FROM fx_links QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_no, pos) = 1""", V)
def dedup_links(spark, sf):
    return L.dedup_links(fx_links(spark, sf), "href").select("page_no", "pos", "href")


def walk(spark, sf, size):
    """Listing pages of `size` events; a link where the event is a sign-up, so some pages have none."""
    events = table(spark, sf, "events").select(
        (F.floor(F.col("event_id") / size) + 1).alias("page_no"), (F.col("event_id") % size).alias("pos"), "event_type")
    links = events.where(F.col("event_type") == "signup").drop("event_type")
    return links, events.select("page_no").distinct()


def walk_sql(size, run):
    return f"""
WITH p AS (SELECT CAST(floor(event_id / {size}) AS BIGINT) + 1 AS page_no, event_id % {size} AS pos, event_type FROM events),
k AS (SELECT page_no, pos FROM p WHERE event_type = 'signup'),
e AS (SELECT page_no FROM (SELECT DISTINCT page_no FROM p) a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page_no = a.page_no)),
s AS (SELECT a.page_no FROM e a WHERE (SELECT count(*) FROM e b WHERE b.page_no BETWEEN a.page_no AND a.page_no + {run - 1}) = {run})
SELECT page_no, pos FROM k WHERE page_no < coalesce((SELECT min(page_no) FROM s), 9223372036854775807)"""


@query("until_empty", walk_sql(20, 1))
def until_empty(spark, sf):
    return L.until_empty(*walk(spark, sf, 20), run=1)


@query("until_empty3", walk_sql(5, 3))
def until_empty3(spark, sf):
    return L.until_empty(*walk(spark, sf, 5), run=3)


@query("page_cap", "SELECT page_no, pos, href FROM fx_links WHERE page_no <= 15", V)
def page_cap(spark, sf):
    return L.page_cap(fx_links(spark, sf), L.PAGE_CAPS["regular_full"]).select("page_no", "pos", "href")


def missing_sql(tail):
    return f"""
WITH p AS (SELECT CAST(floor(event_id / 5) AS BIGINT) + 1 AS page_no, event_type FROM events),
f AS (SELECT DISTINCT page_no FROM p)
SELECT page_no, CASE WHEN page_no = 1 THEN '{BASE}/classifieds/all/jobs/' ELSE '{BASE}/classifieds/all/jobs/' || {tail} END AS url FROM f
WHERE page_no NOT IN (SELECT page_no FROM p WHERE event_type = 'signup')"""


def _missing(spark, sf, style):
    links, every = walk(spark, sf, 5)
    n = every.agg(F.max("page_no")).first()[0]
    frontier = L.page_frontier(spark, f"{BASE}/classifieds/all/jobs/", n, style)
    stored = links.select("page_no").distinct().join(frontier, "page_no")
    return L.missing_pages(frontier, stored)


@query("page_frontier", missing_sql("'index' || CAST((page_no - 1) * 100 AS VARCHAR) || '.html'"))
def page_frontier(spark, sf):
    return _missing(spark, sf, "offset")


@query("page_frontier_query", missing_sql("'?page=' || CAST(page_no AS VARCHAR)"))
def page_frontier_query(spark, sf):
    return _missing(spark, sf, "query")


@query("posting_urls", f"""
SELECT page_no, pos, ({POSTING}) AS strict, (contains(href, '/cls/') AND contains(href, '.html')) AS loose,
  contains(href, '/cls/') AS by_path, (contains(href, '/cls/') OR contains(href, '/classifieds/')) AS by_paths FROM fx_links""", V)
def posting_urls(spark, sf):
    h = F.col("href")
    return fx_links(spark, sf).select(
        "page_no", "pos", tags.is_posting_url(h).alias("strict"), tags.is_posting_url(h, strict=False).alias("loose"),
        tags.is_posting_url(h, paths=["/cls/"]).alias("by_path"),
        tags.is_posting_url(h, paths=["/cls/", "/classifieds/"]).alias("by_paths"))


HALF_ABSOLUTE = f"CASE WHEN pos % 2 = 0 THEN concat('{BASE}', href) ELSE href END"


@query("absolutize", f"""
WITH h AS (SELECT page_no, pos, {HALF_ABSOLUTE} AS href FROM fx_links)
SELECT page_no, pos, CASE WHEN prefix(href, 'http') THEN href ELSE '{BASE}' || href END AS url FROM h""", V)
def absolutize(spark, sf):
    mixed = fx_links(spark, sf).withColumn("href", F.expr(HALF_ABSOLUTE))
    return L.absolutize(mixed, BASE).select("page_no", "pos", "url")


@query("select_class", """
SELECT page_no, pos, href AS url, suffix(parent_text, 'Sponsored') AS is_sponsored FROM fx_links
QUALIFY row_number() OVER (PARTITION BY href, suffix(parent_text, 'Sponsored') ORDER BY page_no, pos) = 1""", V)
def select_class(spark, sf):
    return C.select_class(fx_links(spark, sf).withColumnRenamed("href", "url"), include_sponsored=True).select(
        "page_no", "pos", "url", "is_sponsored")


@query("select_regular", """
SELECT page_no, pos, href AS url FROM fx_links WHERE NOT suffix(parent_text, 'Sponsored')
QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_no, pos) = 1""", V)
def select_regular(spark, sf):
    return C.select_class(fx_links(spark, sf).withColumnRenamed("href", "url")).select("page_no", "pos", "url")


@query("union_classes", f"""
WITH {STRICT_LINKS} SELECT page_no, pos, link_class = 'sponsored' AS is_sponsored FROM c WHERE link_class IN ('sponsored', 'regular')""", V)
def union_classes(spark, sf):
    links = strict_links(spark, sf).select("page_no", "pos", "link_class")
    c = F.col("link_class")
    return C.union_classes(links.where(c == "regular"), links.where(c == "sponsored")).drop("link_class")


@query("distinct_links", """
SELECT DISTINCT url FROM (SELECT href AS url FROM fx_links
  UNION ALL SELECT regexp_replace(url, '^https://jobs.example.com', '') FROM fx_postings)""", ("fx_links", "fx_postings"))
def distinct_links(spark, sf):
    from jobsieve.registry.base import fx_postings

    other = fx_postings(spark, sf).select(F.regexp_replace("url", "^https://jobs.example.com", "").alias("url"))
    return L.distinct_links(fx_links(spark, sf).select(F.col("href").alias("url")), other)


@query("page_kind", """
WITH k AS (SELECT page_no, pos, href, CASE WHEN contains(href, '/classifieds/') AND suffix(href, '/jobs/') THEN 'category'
  WHEN contains(href, '/cls/') THEN 'job_detail' END AS type FROM fx_links)
SELECT page_no, pos, type, CASE WHEN type = 'category' THEN 'Job Category: ' || string_split(href, '/')[-3] END AS category_title
FROM k WHERE type IS NOT NULL""", V)
def page_kind(spark, sf):
    return L.page_kind(fx_links(spark, sf), "href").select("page_no", "pos", "type", "category_title")


@query("category_records", f"""
SELECT 'Job Category: ' || string_split(href, '/')[-3] AS title, href AS url, 'Saudi Arabia' AS location,
  'This is a job category page with multiple listings' AS description, 'category' AS type, '{NOW}' AS date_posted, '{NOW}' AS scraped_at
FROM fx_links WHERE contains(href, '/classifieds/') AND suffix(href, '/jobs/')""", V)
def category_records_of_links(spark, sf):
    return category_records(L.page_kind(fx_links(spark, sf).withColumnRenamed("href", "url")), NOW)


# --- page snapshots ---------------------------------------------------------------

UNSEEN = "(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->"


def untag(x):
    """SQL text of a fragment: tags out, named characters decoded."""
    out = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for name, char in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"),
                       ("&apos;", "''''"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{name}', {char})"
    return out


def trim_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ANCHOR = """(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]*)["'']?[^>]*>(.*?)</a\\s*>"""


@query("page_links", f"""
WITH b AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'),
    '(?i)(</?(?:li|tr|td|p|div)[\\s>])', chr(1) || '\\1', 'g'), chr(1))) AS block,
    generate_subscripts(string_split(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'),
    '(?i)(</?(?:li|tr|td|p|div)[\\s>])', chr(1) || '\\1', 'g'), chr(1)), 1) AS bno FROM pages),
a AS (SELECT page_id, bno, block, unnest(regexp_extract_all(block, '{ANCHOR}', 1)) AS href, unnest(regexp_extract_all(block, '{ANCHOR}', 2)) AS body,
    generate_subscripts(regexp_extract_all(block, '{ANCHOR}', 1), 1) AS ano FROM b WHERE regexp_matches(block, '(?i)<a\\s'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY bno, ano) - 1 AS pos, {untag('href')} AS href,
  {trim_sql(untag('body'))} AS title, {trim_sql(untag('block'))} AS parent_text FROM a""")
def page_links(spark, sf):
    return L.extract_links(spread(table(spark, sf, "pages")).select("page_id", "html"))


TITLE_SQL = f"""trim(regexp_replace({untag("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g'))"""
BODY_SQL = untag(f"regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'), '(?is)^.*?<body[^>]*>', '')")


@query("page_title_text", f"""
SELECT page_id, {TITLE_SQL} AS page_title, {trim_sql(f"regexp_replace({TITLE_SQL}, '^.*?Jobs,\\s*', '')")} AS title,
  substring({BODY_SQL}, 1, 1000) AS preview, CAST(length({BODY_SQL}) AS INT) AS n_chars FROM pages""")
def page_title_text(spark, sf):
    texts = with_page_text(spread(table(spark, sf, "pages")))
    return texts.select("page_id", "page_title", X.clean_title(F.col("page_title"), OWN_DOMAIN).alias("title"),
                        X.preview(F.col("body_text")).alias("preview"), F.length("body_text").alias("n_chars"))


# Pages whose list items hold nested blocks around each anchor: `li`, two `div`, and text beside the anchor in each.
NESTED_ROWS = """replace(replace(replace(html, '<nav><ul>', '<nav><ul class="x listings">'), '<li>',
  '<li>New <div><span class="description">About <b>it</b></span><div>Job '), '</a></li>',
  '</a> today</div> <span class="listing-date">1 July</span></div></li>')"""
LI_ANCHOR = "(?is)<li><a\\s[^>]*?href\\s*=\\s*[\"'']?([^\"''\\s>]*)[\"'']?[^>]*>(.*?)</a></li>"
NESTED_SQL = f"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '{LI_ANCHOR}', 1)) AS href,
  unnest(regexp_extract_all(html, '{LI_ANCHOR}', 2)) AS body, generate_subscripts(regexp_extract_all(html, '{LI_ANCHOR}', 1), 1) AS no FROM pages)"""


@query("page_links_nested", f"""
WITH {NESTED_SQL} SELECT page_id, no - 1 AS pos, {untag('href')} AS href, {trim_sql(untag('body'))} AS title,
  'Job ' || {untag('body')} || ' today' AS parent_text FROM a""")
def page_links_nested(spark, sf):
    """The parent's text is that of the innermost element around the anchor."""
    pages = spread(table(spark, sf, "pages")).select("page_id", F.expr(NESTED_ROWS).alias("html"))
    return L.extract_links(pages)


@query("listing_rows_nested", f"""
WITH {NESTED_SQL}, t AS (SELECT *, trim(regexp_replace({untag('body')}, '\\s+', ' ', 'g')) AS title FROM a WHERE no <= 20)
SELECT page_id, no AS row_no, CASE WHEN length(title) > 100 THEN substring(title, 1, 100) || '...' ELSE title END AS title,
  '{BASE}' || {untag('href')} AS link_url, '1 July' AS date_posted, 'Saudi Arabia' AS location, 'About it' AS description
FROM t WHERE length(title) >= 3""")
def listing_rows_nested(spark, sf):
    pages = spread(table(spark, sf, "pages")).select("page_id", F.expr(NESTED_ROWS).alias("html"))
    return L.listing_rows(pages, BASE, "/jobs/")


NAV_RULE = Selector(tag="li", parent=Selector(tag="ul", parent=Selector(tag="nav")))
SQUEEZED_ROW = f"trim(regexp_replace({untag('row_html')}, '\\s+', ' ', 'g'))"


@query("listing_rows", f"""
WITH r AS (SELECT page_id, unnest(list_slice(regexp_extract_all(regexp_extract(html, '(?is)<nav(?:\\s[^>]*)?>.*?</nav\\s*>', 0),
    '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1), 1, 20)) AS row_html,
  generate_subscripts(list_slice(regexp_extract_all(regexp_extract(html, '(?is)<nav(?:\\s[^>]*)?>.*?</nav\\s*>', 0),
    '(?is)<li(?:\\s[^>]*)?>(.*?)</li\\s*>', 1), 1, 20), 1) AS row_no FROM pages)
SELECT page_id, CAST(row_no AS BIGINT) AS row_no, {SQUEEZED_ROW} AS title,
  '{BASE}' || {untag(f"regexp_extract(row_html, '{ANCHOR}', 1)")} AS link_url, CAST(NULL AS VARCHAR) AS date_posted,
  'Saudi Arabia' AS location, {SQUEEZED_ROW} AS description FROM r WHERE length({SQUEEZED_ROW}) >= 3""")
def listing_rows(spark, sf):
    pages = spread(table(spark, sf, "pages")).select("page_id", "html")
    return L.listing_rows(pages, BASE, "/jobs/", rules=(*L.LISTING_RULES, NAV_RULE))


CUT = "CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


@query("listing_rows_fallback", f"""
WITH a AS (SELECT page_id, list_slice(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*>.*?</a\\s*>', 0),
    lambda x: contains(regexp_extract(x, '{ANCHOR}', 1), '/')), 1, 10) AS l FROM pages),
r AS (SELECT page_id, unnest(l) AS row_html, generate_subscripts(l, 1) AS row_no FROM a),
t AS (SELECT page_id, row_no, row_html, coalesce(nullif(trim(regexp_replace({untag(f"regexp_extract(row_html, '{ANCHOR}', 2)")}, '\\s+', ' ', 'g')), ''),
    'Job Listing ' || CAST(row_no AS VARCHAR)) AS t FROM r)
SELECT page_id, CAST(row_no AS BIGINT) AS row_no, {CUT.format(x='t', n=100)} AS title,
  '{BASE}' || {untag(f"regexp_extract(row_html, '{ANCHOR}', 1)")} AS link_url, CAST(NULL AS VARCHAR) AS date_posted,
  'Saudi Arabia' AS location, {CUT.format(x='t', n=200)} AS description FROM t""")
def listing_rows_fallback(spark, sf):
    return L.listing_rows(spread(table(spark, sf, "pages")).select("page_id", "html"), BASE, "/")


CITIES = {name: f"{BASE}/classifieds/{name.lower()}/jobs/" for name in ("Riyadh", "Jeddah", "Dammam", "Khobar")}
CITY_PAGE = (f"concat('{BASE}/classifieds/', CASE page_no % 4 WHEN 0 THEN 'riyadh' WHEN 1 THEN 'jeddah' WHEN 2 THEN 'dammam' ELSE 'khobar' END, '/jobs/')")
CITY_TEXT = ("concat(parent_text, CASE WHEN pos % 3 = 0 THEN concat(' Driver with license, ', CAST(1000 + pos AS STRING), ' SAR, full-time, call 055 ', "
             "CAST(1000000 + page_no AS STRING)) WHEN pos % 3 = 1 THEN ' contract, sales assistant' ELSE '' END)")
LISTING_WORDS = P.LISTING_SKILLS


def city_links(spark, sf):
    return fx_links(spark, sf).select(
        F.col("page_no").alias("page_id"), "pos", "href", F.expr(CITY_PAGE).alias("url"), F.lit("").alias("title"),
        F.expr(CITY_TEXT).alias("parent_text"))


SKILL_LIST = "[" + ", ".join(f"'{w}'" for w in LISTING_WORDS) + "]"


@query("city_listing", f"""
WITH l AS (SELECT page_no, pos, href, {CITY_PAGE} AS page_url, {CITY_TEXT} AS t,
    CASE page_no % 4 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'Jeddah' WHEN 2 THEN 'Dammam' ELSE 'Khobar' END AS city FROM fx_links
  WHERE contains(href, '/cls/')),
o AS (SELECT *, {trim_sql("regexp_replace(t, '\\s+', ' ', 'g')")} AS flat FROM l QUALIFY row_number() OVER (PARTITION BY city, href ORDER BY page_no, pos) = 1)
SELECT page_no AS page_id, pos, 'Job Listing' AS title, '{BASE}' || href AS url, city AS location,
  nullif(trim(regexp_extract(t, '(?i)(\\d+[\\s,]*(?:sr|sar|riyal|monthly|yearly))', 1)), '') AS salary,
  CASE WHEN length(flat) > 50 THEN {CUT.format(x='flat', n=200)} ELSE '' END AS description,
  CASE WHEN contains(lower(t), 'full-time') THEN 'full-time' WHEN contains(lower(t), 'part-time') THEN 'part-time'
    WHEN contains(lower(t), 'contract') THEN 'contract' WHEN contains(lower(t), 'temporary') THEN 'temporary'
    WHEN contains(lower(t), 'permanent') THEN 'permanent' END AS employment_type,
  array_to_string(list_filter({SKILL_LIST}, lambda w: contains(lower(t), w)), ',') AS skills,
  nullif(regexp_extract(t, '(?:\\+966|05|01)[\\d\\s-]{{8,}}', 0), '') AS contact,
  nullif(regexp_extract(href, '/cls/(\\d+)', 1), '') AS job_id FROM o""", V)
def city_listing(spark, sf):
    return L.city_listing(city_links(spark, sf), CITIES, BASE).withColumn("skills", F.array_join("skills", ","))


@query("challenge_flag", """
SELECT seq, (contains(lower(body_text), 'checking your browser') OR contains(lower(body_text), 'enable javascript and cookies')
  OR contains(lower(body_text), 'cloudflare') OR contains(lower(body_text), 'verify you are human') OR seq % 31 = 0) AS is_challenge
FROM fx_posting_text""", ("fx_posting_text",))
def challenge_flag(spark, sf):
    titled = fx_posting_text(spark, sf).withColumn("page_title", F.when(F.col("seq") % 31 == 0, "Just a moment...").otherwise("Job"))
    return with_challenge_flag(titled).select("seq", "is_challenge")


@query("extraction_ok", f"""
WITH t AS (SELECT seq, body_text, CASE WHEN seq % 31 = 0 THEN '' WHEN seq % 37 = 0 THEN 'www.{OWN_DOMAIN}' ELSE 'Job' END AS title FROM fx_posting_text)
SELECT seq, CASE WHEN contains(lower(body_text), 'verify you are human') THEN 'interstitial page' WHEN title = '' THEN 'no title'
  WHEN title = 'www.{OWN_DOMAIN}' THEN 'title is the host name' END AS error,
  NOT contains(lower(body_text), 'verify you are human') AND title NOT IN ('', 'www.{OWN_DOMAIN}') AS extraction_ok FROM t""", ("fx_posting_text",))
def extraction_ok(spark, sf):
    seq = F.col("seq")
    titled = fx_posting_text(spark, sf).withColumn(
        "title", F.when(seq % 31 == 0, "").when(seq % 37 == 0, f"www.{OWN_DOMAIN}").otherwise("Job"))
    return with_extraction_ok(titled, f"www.{OWN_DOMAIN}").select("seq", "error", "extraction_ok")


# A paragraph without an end tag ends at the next one or with its article.
P_BLOCKS = f"""list_transform(list_filter(string_split(regexp_replace(html, '(?i)(</?p[\\s>]|</article[\\s>])', chr(1) || '\\1', 'g'), chr(1)),
  lambda b: regexp_matches(b, '(?i)^<p[\\s>]')), lambda b: {trim_sql(untag("b"))})"""


@query("block_fields", f"""
SELECT page_id, coalesce(nullif({trim_sql(untag("regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)"))}, ''), 'No title found') AS title,
  coalesce(list_filter({P_BLOCKS}, lambda t: length(t) > 50)[1], 'No description found') AS first_block,
  (CASE WHEN length({trim_sql(untag("regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)"))}) > 100
    THEN trim(regexp_replace({untag("regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)")}, '\\s+', ' ', 'g')) ELSE '' END) AS longest_block
FROM pages""")
def block_fields(spark, sf):
    pages = spread(table(spark, sf, "pages"))
    return _block_fields(pages, X.block_picks((Selector(tag="article"),)))


def _block_fields(pages, longest):
    parts = page_parts(F.col("html"), title=X.title_pick(), block=X.block_pick(), **longest)
    parts, rows = F.col("parts"), computed_once(pages.select("page_id", "html"), {"parts": parts}, ["page_id"])
    return rows.select("page_id", F.coalesce(parts["title"], F.lit(P.NO_TITLE)).alias("title"),
                       F.coalesce(parts["block"], F.lit(P.NO_DESCRIPTION)).alias("first_block"),
                       X.longest_block(parts).alias("longest_block"))


# Pages whose articles stand in nested blocks: by class, id or tag.
NESTED_BLOCK = """replace(replace(html, '<article>', CASE page_id % 3
    WHEN 0 THEN '<div class="wide content"><div>Head <i>line</i></div><div><article>'
    WHEN 1 THEN '<section id="content"><div>Head <i>line</i></div><div><article>'
    ELSE '<main><div>Head <i>line</i></div><div><article>' END),
  '</article>', CASE page_id % 3 WHEN 0 THEN '</article></div></div>' WHEN 1 THEN '</article></div></section>'
    ELSE '</article></div></main>' END)"""
ARTICLE = untag("regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)")


@query("block_fields_nested", f"""
WITH a AS (SELECT page_id, html, 'Head line' || {ARTICLE} AS block FROM pages)
SELECT page_id, coalesce(nullif({trim_sql(untag("regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)"))}, ''), 'No title found') AS title,
  coalesce(CASE WHEN page_id % 3 = 0 AND length({trim_sql('block')}) > 50 THEN {trim_sql('block')} END,
    list_filter({P_BLOCKS}, lambda t: length(t) > 50)[1], 'No description found') AS first_block,
  CASE WHEN length({trim_sql('block')}) > 100 THEN trim(regexp_replace(block, '\\s+', ' ', 'g')) ELSE '' END AS longest_block FROM a""")
def block_fields_nested(spark, sf):
    """The built-in rules; a block's text goes to the end of its own element, whatever elements of its name it holds."""
    pages = spread(table(spark, sf, "pages")).withColumn("html", F.expr(NESTED_BLOCK))
    return _block_fields(pages, X.block_picks())


@query("listing_report", f"""
WITH b AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'),
    '(?i)(</?(?:li|tr|td|p|div)[\\s>])', chr(1) || '\\1', 'g'), chr(1))) AS block FROM pages),
a AS (SELECT page_id, {trim_sql(untag('block'))} AS parent_text, unnest(regexp_extract_all(block, '{ANCHOR}', 1)) AS href FROM b),
p AS (SELECT page_id + 1 AS page_no, parent_text || CASE WHEN length(parent_text) % 3 = 0 THEN ' Sponsored' WHEN length(parent_text) % 3 = 1
  THEN ' Tue, Jul 1, 2025, 5:43:12 PM - a day ago' ELSE '' END AS parent_text FROM a),
c AS (SELECT page_no, {STRICT} AS link_class FROM p), g AS (SELECT page_no, {COUNTS} FROM c GROUP BY 1)
SELECT *, {PCT.format(a='sponsored', b='total')} AS sponsored_pct FROM g""")
def listing_report_pages(spark, sf):
    """Report over links taken from HTML. The pages' own anchors are dressed up as posting links first."""
    pages = spread(table(spark, sf, "pages")).select((F.col("page_id") + 1).alias("page_no"), "html")
    size = F.length("parent_text") % 3
    ending = F.when(size == 0, " Sponsored").when(size == 1, " Tue, Jul 1, 2025, 5:43:12 PM - a day ago").otherwise("")
    links = L.extract_links(pages).withColumn("parent_text", F.concat("parent_text", ending))
    return listing_report(C.classify_links(links.withColumnRenamed("href", "url"), "strict"), pages).page_breakdown
