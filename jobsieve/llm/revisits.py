r"""WARC not-modified revisits: each is resolved by the latest earlier full response of its canonical URL.

A capture is a row of RECORD. Full responses (kind `response`, status 200) may answer later revisits (kind
`revisit`, status 304) of the same canonical URL. The as-of join takes the latest response captured before the
revisit (of one instant: the one with the smaller record id), checks the validators, and merges the headers that a
304 may change into the stored ones.

* An entity tag decides where both sides have one (weak comparison), else Last-Modified, else the payload digest.
  Without any common validator the revisit is `unchecked`; with a different one it is `mismatch`; without an earlier
  response it is `unresolved`. Only `resolved` ones get a merged header block.
* A URL with very many captures is no single group: captures are cut into blocks of BLOCK_SECONDS. Inside a block a
  window finds the latest response; only the last response of each block goes on to a window over the blocks.

NULL or blank URLs and NULL times have no earlier response (`unresolved`); repeated rows are resolved alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 86_400

RECORD = ("record_id bigint, url string, captured_at bigint, kind string, status int, etag string, last_modified string, "
          "digest string, headers map<string, string>")

# Headers that a 304 response must not change in a stored response, in lower case.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "etag",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that tell how a reader came, not what the page is.
TRACKING = ("utm_[a-z]+", "gclid", "fbclid", "phpsessid")


def canonical_url(url: Column) -> Column:
    """One spelling, NULL for a blank address: no scheme, `www.`, default port, fragment, tracking parameters, index page or last slash; host in
    lower case, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i:https?):/+", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/(index\.html?)?$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i:" + "|".join(TRACKING) + ")(=|$)"))
    query = F.array_join(F.array_sort(wanted), "&")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), F.lit(""))


def _opaque(etag: Column) -> Column:
    """An entity tag without the mark of weakness."""
    return F.regexp_replace(etag, "^W/", "")


def checked(revisit: str, response: str) -> Column:
    """Outcome of the first validator that both sides have."""
    a, b = F.col(revisit), F.col(response)
    outcome = F.when(b["record_id"].isNull(), "unresolved")
    for x, y in ((_opaque(a["etag"]), _opaque(b["etag"])), (a["last_modified"], b["last_modified"]), (a["digest"], b["digest"])):
        outcome = outcome.when(x.isNotNull() & y.isNotNull(), F.when(x == y, "resolved").otherwise("mismatch"))
    return outcome.otherwise("unchecked")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers with those of the 304 that it may change; names in lower case.

    Values of one name in several spellings are joined by commas in order of spelling; NULL values among them are left out.
    """
    def low(m: Column) -> Column:
        entries = F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))),
                              lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_arrays(names, F.transform(names, lambda k: F.array_join(
            F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), ", ")))

    allowed = F.map_filter(low(fresh), lambda k, _: ~k.isin(*KEPT_HEADERS))
    kept = F.map_filter(low(stored), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolve(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Every revisit with record_id, url_key, captured_at, response_id, response_at, age_seconds, outcome, headers.

    `records` has the columns of RECORD; others are not carried.
    """
    fields = ("record_id", "captured_at", "etag", "last_modified", "digest", "headers")
    rows = records.select(canonical_url(F.col("url")).alias("url_key"), *fields, "kind", "status")
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    revisit = (F.col("kind") == "revisit") & (F.col("status") == 304)
    rows = rows.select(
        "url_key", F.floor(F.col("captured_at") / block_seconds).alias("block"), "captured_at", "record_id",
        F.coalesce(revisit, F.lit(False)).alias("revisit"), F.struct(*fields).alias("own"),
        F.when(F.coalesce(full, F.lit(False)), F.struct(*fields)).alias("full"))
    rows = rows.where("revisit or full is not null")
    placed = F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()
    lost = rows.where(~placed & F.col("revisit")).select("url_key", "own", F.lit(None).cast(rows.schema["full"].dataType).alias("found"))
    rows = rows.where(placed)

    # The last response of each block, and of all blocks before it.
    order = F.struct("captured_at", -F.col("record_id"))
    ends = rows.where("full is not null").groupBy("url_key", "block").agg(F.max_by("full", order).alias("last"))
    needs = rows.select("url_key", "block").distinct()
    over = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = needs.join(ends, ["url_key", "block"], "left").select(
        "url_key", "block", F.last("last", ignorenulls=True).over(over).alias("carried"))

    # Inside a block; the block's carried response serves where none stands before.
    here = Window.partitionBy("url_key", "block").orderBy("captured_at", F.col("revisit"), F.desc("record_id")).rowsBetween(
        Window.unboundedPreceding, -1)
    found = rows.withColumn("inside", F.last("full", ignorenulls=True).over(here)).where("revisit")
    found = found.join(carried, ["url_key", "block"], "left").select(
        "url_key", "own", F.coalesce("inside", "carried").alias("found"))
    found = found.union(lost).withColumn("outcome", checked("own", "found"))
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("found.headers"), F.col("own.headers")))
    return found.select(
        F.col("own.record_id").alias("record_id"), "url_key", F.col("own.captured_at").alias("captured_at"),
        F.col("found.record_id").alias("response_id"), F.col("found.captured_at").alias("response_at"),
        (F.col("own.captured_at") - F.col("found.captured_at")).alias("age_seconds"), "outcome", headers.alias("headers"))


# Captures of the pages table: every page is fetched in full, some again later as a full response, and three times
# more as a revisit, whose spelling of the URL and validators differ by page. Runs in Spark and DuckDB.
CAPTURES = """
SELECT p.page_id * 8 + p.k AS record_id, p.page_id, p.k AS k,
  CASE WHEN p.k = 3 THEN concat(p.url, '#revisit') WHEN p.k = 4 THEN concat('HTTP://', substr(p.url, strpos(p.url, '//') + 2)) ELSE p.url END AS url,
  CAST(1700000000 + (p.page_id % 9973) * 61 + CASE p.k WHEN 0 THEN 0 WHEN 1 THEN 40000 WHEN 2 THEN 90000 WHEN 3 THEN 200000 ELSE 400000 END AS BIGINT) AS captured_at,
  CASE WHEN p.k IN (0, 2) THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN p.k IN (0, 2) THEN 200 ELSE 304 END AS status,
  CASE WHEN p.page_id % 5 = 0 THEN NULL WHEN p.k = 4 AND p.page_id % 7 = 0 THEN '"changed"'
       ELSE concat(CASE WHEN p.k = 3 THEN 'W/' ELSE '' END, '"', substr(md5(p.html), 1, 12), '"') END AS etag,
  CASE WHEN p.page_id % 3 = 0 THEN NULL ELSE concat('day ', CAST(p.page_id % 28 + CASE WHEN p.k = 1 AND p.page_id % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR(9))) END AS last_modified,
  CASE WHEN p.page_id % 15 = 0 THEN NULL ELSE md5(p.html) END AS digest,
  CAST(length(p.html) AS VARCHAR(20)) AS size
FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM pages) p
WHERE p.url IS NOT NULL AND (p.k <> 2 OR p.page_id % 4 = 0)
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture records (RECORD) derived from page_id, url and html."""
    sql = CAPTURES.replace("unnest([0, 1, 2, 3, 4]) AS k FROM pages", "explode(array(0, 1, 2, 3, 4)) AS k FROM {pages}").replace("strpos(p.url, '//')", "instr(p.url, '//')")
    rows = pages.sparkSession.sql(sql, pages=pages.select("page_id", "url", "html"))
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"),
                          F.lit("Date"), F.col("captured_at").cast("string"), F.lit("Server"), F.lit("origin"))
    fresh = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("DATE"), F.col("captured_at").cast("string"),
                         F.lit("X-Cache"), F.concat(F.lit("hit "), F.col("k").cast("string")))
    return rows.select("record_id", "url", "captured_at", "kind", "status", "etag", "last_modified", "digest",
                       F.when(F.col("kind") == "response", stored).otherwise(fresh).alias("headers"))


def page_revisits(pages: DataFrame) -> DataFrame:
    """All revisits of the pages' captures; headers as sorted `name: value` lines."""
    rows = resolve(page_captures(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return rows.withColumn("headers", F.array_join(lines, "\n"))


# The same in SQL: for every revisit the latest earlier response by canonical URL.
PAGE_REVISITS_SQL = f"""
WITH captures AS ({CAPTURES}),
parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?):/+', '') AS rest FROM captures),
keyed AS (
  SELECT *, nullif(concat(
      regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\\.|:(80|443)$', '', 'g'),
      regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(index\\.html?)?$', ''),
      CASE WHEN len(q) > 0 THEN concat('?', array_to_string(q, '&')) ELSE '' END), '') AS url_key
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:{"|".join(TRACKING)})(=|$)'))) AS q FROM parts)),
joined AS (
  SELECT a.*, b.record_id AS response_id, b.captured_at AS response_at, b.etag AS b_etag, b.last_modified AS b_modified,
         b.digest AS b_digest, b.size AS b_size, b.captured_at AS b_at,
         row_number() OVER (PARTITION BY a.record_id ORDER BY b.captured_at DESC, b.record_id) AS no
  FROM keyed a LEFT JOIN keyed b ON a.url_key = b.url_key AND b.kind = 'response' AND b.captured_at <= a.captured_at
  WHERE a.kind = 'revisit'),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved'
      WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN
        CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(b_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
      WHEN last_modified IS NOT NULL AND b_modified IS NOT NULL THEN
        CASE WHEN last_modified = b_modified THEN 'resolved' ELSE 'mismatch' END
      WHEN digest IS NOT NULL AND b_digest IS NOT NULL THEN CASE WHEN digest = b_digest THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unchecked' END AS outcome
  FROM joined WHERE no = 1)
SELECT record_id, url_key, captured_at, response_id, response_at, captured_at - response_at AS age_seconds, outcome,
  CASE WHEN outcome = 'resolved' THEN concat('content-length: ', b_size, chr(10), 'content-type: text/html', chr(10), 'date: ',
    CAST(captured_at AS VARCHAR), chr(10), 'server: origin', chr(10), 'x-cache: hit ', CAST(k AS VARCHAR)) END AS headers
FROM judged
"""
