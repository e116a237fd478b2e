"""Queries and statistics over postings."""

from pyspark.sql import functions as F

from jobsieve.functions import tags
from jobsieve.operators import classify, query as Q, stats
from jobsieve.registry.base import fx_links, fx_posting_text, fx_postings, query
from jobsieve.functions.fields import salary_phrase
from jobsieve.operators.links import page_kind

P = ("fx_postings",)
NUM = "try_cast(nullif(regexp_replace(salary, '[^0-9]', '', 'g'), '') AS BIGINT)"


@query("search_location", """
SELECT posting_id, title, location, url FROM fx_postings
WHERE (contains(lower(title), 'engineer') OR contains(lower(description), 'engineer') OR contains(lower(location), 'engineer'))
  AND contains(lower(location), 'nation_1')""", P)
def search_location(spark, sf):
    return Q.filtered(fx_postings(spark, sf), "Engineer", "NATION_1").select("posting_id", "title", "location", "url")


@query("min_salary", f"SELECT url, salary FROM fx_postings WHERE trim(salary) = '' OR {NUM} >= 5000", P)
def min_salary(spark, sf):
    return Q.min_salary(fx_postings(spark, sf), 5000).select("url", "salary")


LONG = "concat(salary, ', call 0512345678 or 0512345679')"
LONG_NUM = f"try_cast(nullif(regexp_replace({LONG}, '[^0-9]', '', 'g'), '') AS DOUBLE)"


@query("min_salary_long_digits", f"SELECT url, {LONG} AS salary FROM fx_postings WHERE {LONG_NUM} >= 5000", P)
def min_salary_long_digits(spark, sf):
    return Q.min_salary(fx_postings(spark, sf).withColumn("salary", F.expr(LONG)), 5000).select("url", "salary")


@query("min_salary_first_number", """
SELECT url, salary FROM fx_postings
WHERE trim(salary) = '' OR try_cast(nullif(regexp_extract(salary, '([0-9]+)', 1), '') AS BIGINT) >= 2000""", P)
def min_salary_first_number(spark, sf):
    return Q.min_salary(fx_postings(spark, sf), 2000, "first_number").select("url", "salary")


@query("latest_postings_topn", f"""
SELECT url, posting_id, title, salary FROM fx_postings
WHERE (contains(lower(title), 'sales') OR contains(lower(description), 'sales') OR contains(lower(location), 'sales'))
  AND (trim(salary) = '' OR {NUM} >= 2000)
ORDER BY scraped_at, posting_id, url LIMIT 20""", P)
def latest_postings_topn(spark, sf):
    n = Q.effective_limit(quick=True, auto=True)
    return Q.latest_postings(fx_postings(spark, sf), "sales", None, 2000, n).select("url", "posting_id", "title", "salary")


@query("batch_slice", "SELECT url, title FROM fx_postings ORDER BY seq LIMIT 20 OFFSET 4040", P)
def batch_slice(spark, sf):
    return Q.batch(fx_postings(spark, sf), 4040, 20, ["seq"]).select("url", "title")


@query("batch_numbers", """
SELECT url, CAST((row_number() OVER (ORDER BY scraped_at, seq) - 1) // 20 + 1 AS BIGINT) AS batch_no FROM fx_postings""", P)
def batch_numbers(spark, sf):
    rows = fx_postings(spark, sf).select("url", "scraped_at", "seq")
    return Q.with_batch_no(rows, ["scraped_at", "seq"], 20).select("url", "batch_no")


@query("batch_count", "SELECT count(*) AS total_rows, CAST((count(*) + 19) // 20 AS BIGINT) AS batches FROM fx_postings", P)
def batch_count(spark, sf):
    return Q.n_batches(fx_postings(spark, sf), 20)


@query("query_info", f"""
WITH m AS (SELECT (contains(lower(title), 'driver') OR contains(lower(description), 'driver') OR contains(lower(location), 'driver'))
    AND contains(lower(location), 'nation') AND (trim(salary) = '' OR {NUM} >= 2000) AS hit FROM fx_postings)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE hit) AS matched_rows, least(count(*) FILTER (WHERE hit), 100) AS returned_rows,
  'driver' AS search, 'nation' AS location, CAST(2000 AS BIGINT) AS salary_min, CAST(100 AS BIGINT) AS row_limit FROM m""", P)
def query_info(spark, sf):
    return Q.query_info(fx_postings(spark, sf), "driver", "nation", 2000, 100)


@query("with_contact", "SELECT url, contact, email FROM fx_postings WHERE contact <> '' OR email <> ''", P)
def with_contact(spark, sf):
    return Q.with_contact(fx_postings(spark, sf)).select("url", "contact", "email")


@query("with_salary", "SELECT title, salary FROM fx_postings WHERE salary <> ''", P)
def with_salary(spark, sf):
    return Q.with_salary(fx_postings(spark, sf)).select("title", "salary")


DIGITS = "nullif(ltrim(regexp_replace(salary, '[^0-9]', '', 'g'), '0'), '')"
# Every ninth salary gets so many digits more that no BIGINT, and no exact DOUBLE, holds it.
DEEP = "CASE WHEN seq % 9 = 0 THEN concat(salary, repeat('83', CAST(7 + seq % 5 AS INT))) ELSE salary END"


def long_postings(spark, sf):
    return fx_postings(spark, sf).withColumn("salary", F.expr(DEEP))


@query("posting_counts", f"""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE {NUM} > 0) AS jobs_with_salary,
  count(*) FILTER (WHERE trim(contact) <> '') AS jobs_with_contact, count(*) FILTER (WHERE trim(email) <> '') AS jobs_with_email,
  count(*) FILTER (WHERE is_sponsored = 'Yes') AS sponsored_jobs FROM fx_postings""", P)
def posting_counts(spark, sf):
    return stats.posting_counts(fx_postings(spark, sf))


@query("posting_counts_long_digits", """
WITH p AS (SELECT * REPLACE ({long} AS salary) FROM fx_postings)
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE {digits} IS NOT NULL) AS jobs_with_salary,
  count(*) FILTER (WHERE trim(contact) <> '') AS jobs_with_contact, count(*) FILTER (WHERE trim(email) <> '') AS jobs_with_email,
  count(*) FILTER (WHERE is_sponsored = 'Yes') AS sponsored_jobs FROM p""".format(long=DEEP, digits=DIGITS), P)
def posting_counts_long_digits(spark, sf):
    return stats.posting_counts(long_postings(spark, sf))


@query("coverage", """
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE salary <> '') AS with_salary, count(*) FILTER (WHERE contact <> '') AS with_contact,
  count(*) FILTER (WHERE email <> '') AS with_email, count(*) FILTER (WHERE location <> '') AS with_location,
  count(*) FILTER (WHERE description <> '') AS with_description, count(*) FILTER (WHERE employment_type <> '') AS with_employment_type
FROM fx_postings""", P)
def coverage(spark, sf):
    return stats.coverage(fx_postings(spark, sf),
                          ("salary", "contact", "email", "location", "description", "employment_type"))


@query("coverage_nulls", """
SELECT count(*) AS count, count(*) FILTER (WHERE fx_postings.salary <> '') AS with_salary, count(*) FILTER (WHERE contact <> '') AS with_contact,
  count(*) FILTER (WHERE contains(body_text, 'license') OR contains(lower(body_text), 'driver') OR contains(lower(body_text), 'engineer')
    OR contains(lower(body_text), 'sales') OR contains(lower(body_text), 'mechanic')) AS with_skills
FROM fx_postings JOIN fx_posting_text USING (seq)""", ("fx_postings", "fx_posting_text"))
def coverage_nulls(spark, sf):
    rows = fx_postings(spark, sf).select("seq", F.nullif("salary", F.lit("")).alias("salary"),
                                         F.nullif("contact", F.lit("")).alias("contact"))
    texts = fx_posting_text(spark, sf).select("seq", tags.tag_skills(F.col("body_text"), tags.P.LISTING_SKILLS).alias("skills"))
    return stats.coverage(rows.join(texts, "seq"), ("salary", "contact"), null_style=True, list_fields=("skills",))


@query("top_locations", """
SELECT CASE WHEN location = '' THEN 'Unknown' ELSE location END AS location, count(*) AS n FROM fx_postings
GROUP BY 1 ORDER BY n DESC, location LIMIT 10""", P)
def top_locations(spark, sf):
    return stats.top_locations(fx_postings(spark, sf))


@query("search_top_locations", """
SELECT CASE WHEN location = '' THEN 'Unknown' ELSE location END AS location, count(*) AS n FROM fx_postings
WHERE contains(lower(title), 'engineer') OR contains(lower(description), 'engineer') OR contains(lower(location), 'engineer')
GROUP BY 1 ORDER BY n DESC, location LIMIT 10""", P)
def search_top_locations(spark, sf):
    return stats.top_locations(Q.search(fx_postings(spark, sf), "engineer"))


@query("n_locations", "SELECT count(DISTINCT CASE WHEN location = '' THEN 'Unknown' ELSE location END) AS total_unique_locations FROM fx_postings", P)
def n_locations(spark, sf):
    return stats.n_locations(fx_postings(spark, sf))


def salary_sql(source):
    return f"""
s AS (SELECT {DIGITS} AS d FROM {source} WHERE {DIGITS} IS NOT NULL),
l AS (SELECT list_sort(list({{'l': length(d), 'd': d}})) AS l, sum(d::HUGEINT) AS total, count(*) AS count FROM s),
f AS (SELECT count, CAST(l[1].d AS DOUBLE) AS min, CAST(l[-1].d AS DOUBLE) AS max, CAST(l[count // 2 + 1].d AS DOUBLE) AS median,
  CAST((2 * total + count) // (2 * count) AS DOUBLE) AS average FROM l)"""


@query("salary_stats", f"WITH {salary_sql('fx_postings')} SELECT * FROM f", P)
def salary_stats(spark, sf):
    return stats.salary_stats(fx_postings(spark, sf))


@query("salary_stats_long_digits", f"""
WITH p AS (SELECT {DEEP} AS salary FROM fx_postings), {salary_sql('p')} SELECT * FROM f""", P)
def salary_stats_long_digits(spark, sf):
    return stats.salary_stats(long_postings(spark, sf))


@query("contact_methods", """
SELECT CASE WHEN trim(contact) <> '' AND trim(email) <> '' THEN 'both' WHEN trim(contact) <> '' THEN 'phone'
  WHEN trim(email) <> '' THEN 'email' ELSE 'neither' END AS method, count(*) AS n FROM fx_postings GROUP BY 1""", P)
def contact_methods(spark, sf):
    return stats.contact_methods(fx_postings(spark, sf))


def export_sql(salary):
    return f"""
WITH p AS (SELECT * REPLACE ({salary} AS salary), CASE WHEN location = '' THEN 'Unknown' ELSE location END AS loc FROM fx_postings),
{salary_sql('p')},
top AS (SELECT loc, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, loc LIMIT 10)
SELECT (SELECT count(*) FROM p) AS total_jobs, f.count AS jobs_with_salary,
  (SELECT count(*) FROM p WHERE contact <> '') AS jobs_with_contact, (SELECT count(*) FROM p WHERE email <> '') AS jobs_with_email,
  (SELECT count(*) FROM p WHERE is_sponsored = 'Yes') AS sponsored_jobs, (SELECT count(DISTINCT loc) FROM p) AS total_unique_locations,
  (SELECT string_agg(loc || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, loc) FROM top) AS top_locations, f.*,
  (SELECT count(*) FROM p WHERE contact <> '' AND email = '') AS phone, (SELECT count(*) FROM p WHERE contact = '' AND email <> '') AS email,
  (SELECT count(*) FROM p WHERE contact <> '' AND email <> '') AS "both", (SELECT count(*) FROM p WHERE contact = '' AND email = '') AS neither
FROM f"""


def _export_stats(postings):
    top = F.transform("locations.top_locations", lambda x: F.concat(x["location"], F.lit(":"), x["n"].cast("string")))
    return stats.export_stats(postings).select(
        "job_counts.*", "locations.total_unique_locations", F.array_join(top, "|").alias("top_locations"),
        "salary_analysis.*", "contact_methods.*")


@query("export_stats", export_sql("salary"), P)
def export_stats(spark, sf):
    return _export_stats(fx_postings(spark, sf))


@query("export_stats_long_digits", export_sql(DEEP), P)
def export_stats_long_digits(spark, sf):
    return _export_stats(long_postings(spark, sf))


@query("job_family", """
SELECT CASE WHEN contains(lower(title), 'driver') THEN 'driver' WHEN contains(lower(title), 'engineer') THEN 'engineer'
  WHEN contains(lower(title), 'manager') THEN 'manager' WHEN contains(lower(title), 'sales') THEN 'sales'
  WHEN contains(lower(title), 'mechanic') THEN 'mechanic' WHEN contains(lower(title), 'teacher') THEN 'teacher'
  WHEN contains(lower(title), 'nurse') THEN 'nurse' ELSE 'other' END AS family, count(*) AS n FROM fx_postings GROUP BY 1""", P)
def job_family(spark, sf):
    return fx_postings(spark, sf).groupBy(tags.job_family(F.col("title")).alias("family")).agg(F.count("*").alias("n"))


@query("distinct_values", "SELECT DISTINCT location FROM fx_postings WHERE location <> ''", P)
def distinct_values(spark, sf):
    return stats.distinct_values(fx_postings(spark, sf), "location")


@query("split_counts", "SELECT is_sponsored, count(*) AS n FROM fx_postings GROUP BY 1", P)
def split_counts(spark, sf):
    return stats.split_counts(fx_postings(spark, sf))


@query("kind_summary", """
WITH k AS (SELECT CASE WHEN contains(href, '/classifieds/') AND suffix(href, '/jobs/') THEN 'category'
    WHEN contains(href, '/cls/') THEN 'job_detail' END AS type, parent_text FROM fx_links)
SELECT count(*) FILTER (WHERE type = 'job_detail') AS job_details, count(*) FILTER (WHERE type = 'category') AS categories,
  count(*) FILTER (WHERE type IS NOT NULL AND regexp_matches(parent_text, '(?i)\\d+[\\s,]*(?:sr|sar|riyal|monthly|yearly)')) AS with_salary,
  CAST(0 AS BIGINT) AS with_company, count(*) FILTER (WHERE type IS NOT NULL AND parent_text = '') AS errors FROM k""", ("fx_links",))
def kind_summary(spark, sf):
    rows = page_kind(fx_links(spark, sf), "href").select(
        "type", salary_phrase(F.col("parent_text")).alias("salary"), F.lit(None).cast("string").alias("company"),
        F.when(F.col("parent_text") == "", "no text").alias("error"))
    return stats.kind_summary(rows)


@query("run_outcome", """
WITH c AS (SELECT count(*) AS processed, count(*) FILTER (WHERE NOT (contains(lower(body_text), 'verify you are human')
  OR contains(lower(body_text), 'checking your browser'))) AS extracted FROM fx_posting_text)
SELECT processed, extracted, processed - extracted AS failed,
  CASE WHEN processed = 0 THEN 0 ELSE CAST((200 * extracted + processed) // (2 * processed) AS BIGINT) END AS success_rate FROM c""",
       ("fx_posting_text",))
def run_outcome(spark, sf):
    counts = fx_posting_text(spark, sf).agg(
        F.count("*").alias("processed"), F.count_if(~tags.is_challenge(F.col("body_text"))).alias("extracted"))
    return classify.run_outcome(counts)
