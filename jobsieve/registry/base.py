"""Registration of named queries and the input views they share.

The views turn the star-schema and event tables into postings, listing links and posting
texts. Their SQL runs unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsieve.session import spread

OWN_DOMAIN = "listings.example.com"
BASE = "https://jobs.example.com"
STAMP = "2025-07-01T00:00:00.000Z"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FX_POSTINGS = """
SELECT CASE o.o_orderkey % 8 WHEN 0 THEN 'Truck Driver' WHEN 1 THEN 'Site Engineer' WHEN 2 THEN 'Sales Manager'
            WHEN 3 THEN 'Sales Agent' WHEN 4 THEN 'Mechanic' WHEN 5 THEN 'Teacher' WHEN 6 THEN 'Nurse' ELSE 'Cook, "Head"' END AS title,
       CASE WHEN o.o_orderkey % 5 = 0 THEN '' WHEN o.o_orderkey % 11 = 0 THEN 'negotiable' WHEN o.o_orderkey % 13 = 0 THEN '2000-3000'
            WHEN o.o_orderkey % 3 = 0 THEN concat(CAST(1000 + o.o_orderkey % 7000 AS STRING), ' SAR')
            ELSE CAST(1000 + o.o_orderkey % 7000 AS STRING) END AS salary,
       CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE concat('05', lpad(CAST(o.o_custkey AS STRING), 8, '0')) END AS contact,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE concat('user', CAST(o.o_custkey AS STRING), '@mail.example.com') END AS email,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE n.n_name END AS location,
       CASE WHEN o.o_orderkey % 97 = 0 THEN '' ELSE CAST(60000000 + o.o_orderkey AS STRING) END AS posting_id,
       CASE WHEN o.o_orderpriority LIKE '1%' THEN 'full-time' WHEN o.o_orderpriority LIKE '2%' THEN 'part-time' ELSE '' END AS employment_type,
       concat('Hiring in ', n.n_name, ' segment ', c.c_mktsegment) AS description,
       concat('https://jobs.example.com/cls/', CAST(60000000 + o.o_orderkey AS STRING), '.html') AS url,
       o.o_orderdate AS scraped_at,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS is_sponsored,
       o.o_orderkey AS seq
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

FX_LINKS = """
SELECT CAST(floor(event_id / 100) AS BIGINT) + 1 AS page_no, event_id % 100 AS pos,
       CASE WHEN event_id % 19 = 0 THEN '/classifieds/riyadh/jobs/'
            WHEN event_id % 23 = 0 THEN concat('/cls/', CAST(event_id AS STRING), '.html')
            ELSE concat('/cls/', CAST(60000000 + event_id % 4000 AS STRING), '.html') END AS href,
       CASE event_type WHEN 'error' THEN concat('Job ', CAST(user_id AS STRING), ' Sponsored')
            WHEN 'view' THEN concat('Job Tue, Jul 1, 2025, 5:43:12 PM - ', CAST(user_id AS STRING), ' minutes ago')
            WHEN 'click' THEN 'Job Tue, Jul 1, 2025, 5:43:12 PM - an hour ago'
            WHEN 'signup' THEN concat('Job posted ', CAST(user_id % 28 + 1 AS STRING), '/7/2025')
            ELSE '' END AS parent_text
FROM {events}
"""

FX_POSTING_TEXT = """
SELECT seq, url, title, salary, location, concat('From: ', CASE WHEN email = '' THEN 'noreply@listings.example.com' ELSE email END, chr(10),
  'Posted: Sunday, Jun 29, 2025, 9:09:17 PM', chr(10), 'Category: Jobs', chr(10), 'Region: ', location, ' (', location, ')', chr(10),
  CASE WHEN posting_id = '' THEN '' ELSE concat('Posting ID: ', posting_id, chr(10)) END,
  CASE WHEN contact = '' THEN '' ELSE concat(contact, chr(10)) END, 'Chat on WhatsApp', chr(10), 'xx ', title, chr(10),
  CASE WHEN salary = '' THEN '' ELSE concat('Salary: ', salary, chr(10)) END, employment_type, chr(10),
  'Requirements: Valid driving license and iqama are needed here', chr(10),
  'What We Offer: Accommodation and transport by company', chr(10), 'Back Next', chr(10),
  CASE WHEN seq % 29 = 0 THEN 'Verify you are human' ELSE '' END) AS body_text
FROM {fx_postings}
"""

# A longer text: labelled lines, an English sentence with skills, loose phone numbers, a body over 1,500 characters.
FX_RICH_TEXT = """
SELECT seq, url, title, salary, location, concat(
  CASE WHEN seq % 2 = 0 THEN concat('Hiring For ', title, ' team', chr(10)) ELSE '' END,
  'Company: ', description, ' Ltd', chr(10), 'Experience: ', CAST(seq % 9 AS STRING), ' years', chr(10),
  'Degree: ', CASE WHEN seq % 3 = 0 THEN 'Diploma' ELSE 'Bachelor' END, ' or higher', chr(10),
  'Wage: ', CASE WHEN salary = '' THEN 'open' ELSE salary END, ' monthly', chr(10),
  'City: ', location, chr(10),
  CASE WHEN seq % 7 = 0 THEN concat('Work in Riyadh or Jeddah', chr(10)) WHEN seq % 5 = 0 THEN concat('Site near abha', chr(10)) ELSE '' END,
  'Mobile: +966 5', CAST(seq AS STRING), ' 123 4567', chr(10), 'Email: user', CAST(seq AS STRING), '@mail.example.com', chr(10),
  'Skills: English, Excel and driving', chr(10), 'Note: a', chr(9), 'b: c', chr(10), 'Note: d', chr(10), employment_type, chr(10),
  CASE WHEN seq % 4 = 0 THEN concat('Chat on WhatsApp', chr(10), 'Short text', chr(10)) ELSE '' END,
  'Job Details: Position: ', title, chr(10), chr(10), chr(10), chr(10), 'Must have a valid license. ',
  repeat(concat('Long shifts, night work and weekends may apply; meals are served on site and buses run from the city', chr(10)), CAST(seq % 24 AS INT)),
  'Qualifications 1. license 2. iqama', chr(10), 'Medical cover and flights are provided each year', chr(10),
  'For More Details Contact: office', chr(10), '© 2025') AS body_text
FROM {fx_postings}
"""

_CTE = {
    "fx_postings": FX_POSTINGS.format(orders="orders", customer="customer", nation="nation"),
    "fx_links": FX_LINKS.format(events="events"),
    "fx_posting_text": FX_POSTING_TEXT.format(fx_postings="fx_postings"),
    "fx_rich_text": FX_RICH_TEXT.format(fx_postings="fx_postings"),
}
_NEEDS = {"fx_posting_text": ("fx_postings",), "fx_rich_text": ("fx_postings",)}


def fx_postings(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """`wide` spreads the orders over all cores, for the heavy text expressions."""
    tables = {t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    if wide:
        tables["orders"] = spread(tables["orders"].drop("o_totalprice"), narrow=True)
    return spark.sql(FX_POSTINGS, **tables)


def fx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_LINKS, events=table(spark, sf_dir, "events"))


def fx_posting_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_POSTING_TEXT, fx_postings=fx_postings(spark, sf_dir, wide=True))


def fx_rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FX_RICH_TEXT, fx_postings=fx_postings(spark, sf_dir, wide=True))


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; `views` become WITH clauses in front of its SQL."""
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            needed: list[str] = []
            for view in views:
                needed += [v for v in (*_NEEDS.get(view, ()), view) if v not in needed]
            head = ", ".join(f"{v} AS ({_CTE[v]})" for v in needed)
            body = sql.strip()
            if head and body.upper().startswith("WITH "):
                body = f"WITH {head}, {body[5:]}"
            elif head:
                body = f"WITH {head} {body}"
            ORACLES[name] = body
        return f
    return register
