"""Listing pages to a link table, and the walk over listing pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.elements import Selector, listing_items, page_anchors
from jobsieve.functions.fields import contact_loose, job_id, salary_phrase, short_description
from jobsieve.functions.text import blank_to_null, ellipsis, squeezed
from jobsieve.operators.keyed import dedup


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per anchor with an address: `pos` in the page, `href`, `title`, `parent_text`; the HTML is left behind.

    `parent_text` is the text of the anchor's parent element. A page carries it once, however many anchors share it;
    the rows repeat it, so steps behind should drop it once it is classified.
    """
    keep = [c for c in pages.columns if c != html]
    found = pages.select(*keep, page_anchors(F.col(html)).alias("_a"))
    rows = found.select(*keep, F.col("_a.parents").alias("_parents"), F.posexplode("_a.anchors").alias("pos", "link"))
    return rows.select(*keep, F.col("pos").cast("bigint").alias("pos"), "link.href", "link.title",
                       F.get("_parents", F.col("link.parent")).alias("parent_text"))


def absolutize(df: DataFrame, base: str, href: str = "href", out: str = "url") -> DataFrame:
    """Relative addresses get the site's base in front."""
    h = F.col(href)
    return df.withColumn(out, F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base), h)))


def posting_links(links: DataFrame, strict: bool = True, paths: Sequence[str] | None = None,
                  href: str = "href") -> DataFrame:
    """Links that lead to postings."""
    return links.where(tags.is_posting_url(F.col(href), strict, paths))


def page_frontier(spark: SparkSession, base: str, n: int, style: str = "offset") -> DataFrame:
    """Addresses of the first n listing pages; page 1 is the bare address."""
    page = F.col("page_no")
    if style == "offset":
        tail = F.concat(F.lit("index"), ((page - 1) * 100).cast("string"), F.lit(".html"))
    elif style == "query":
        tail = F.concat(F.lit("?page="), page.cast("string"))
    else:
        raise ValueError(f"unknown style {style!r}")
    pages = spark.range(1, n + 1).select(F.col("id").alias("page_no"))
    return pages.select("page_no", F.when(page == 1, F.lit(base)).otherwise(F.concat(F.lit(base), tail)).alias("url"))


def missing_pages(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier pages of which no snapshot exists yet."""
    return frontier.join(pages.select("url"), "url", "left_anti").select(*frontier.columns)


def page_cap(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("page_no") <= n)


# Page caps of the run modes.
PAGE_CAPS = {
    "regular_quick": 2,
    "regular_auto": 3,
    "regular_full": 15,
    "simple_quick": 2,
    "simple_full": 20,
    "all_quick": 5,
    "all_full": 30,
    "comprehensive": 50,
}


def dedup_links(links: DataFrame, key: str = "url", order: Sequence[str] = ("page_no", "pos")) -> DataFrame:
    """First occurrence of each address in order of discovery."""
    return dedup(links, key, order, null_key="collapse")


def first_empty_run(links: DataFrame, frontier: DataFrame, run: int = 1) -> DataFrame:
    """One row `stop_page`: first page of the first `run` neighbouring pages without links, or NULL.

    Each empty page votes for the `run` page numbers a run through it could start at;
    a page with `run` votes starts one. No ordered scan over all pages is needed.
    """
    empty = frontier.select("page_no").join(links.select("page_no").distinct(), "page_no", "left_anti")
    if run == 1:
        starts = empty
    else:
        votes = empty.select(F.explode(F.sequence(F.col("page_no") - (run - 1), F.col("page_no"))).alias("page_no"))
        starts = votes.groupBy("page_no").count().where(F.col("count") == run)
    return starts.agg(F.min("page_no").alias("stop_page"))


def until_empty(links: DataFrame, frontier: DataFrame, run: int = 1) -> DataFrame:
    """Links of the pages before the walk stops: at the first empty page, or the first `run` in a row.

    `links` is read twice, so hand in a stored link table rather than raw pages.
    """
    stop = first_empty_run(links, frontier, run).scalar()
    return links.where(F.col("page_no") < F.coalesce(stop, F.lit((1 << 63) - 1)))


# Listing rules in order of preference, and the parts of a row.
LISTING_RULES = (
    Selector(tag="li", parent=Selector(tag="ul", cls="listings")),
    Selector(cls="listing-item"),
    Selector(cls="job-listing"),
    Selector(part="listing"),
    Selector(tag="tr", part="listing"),
    Selector(cls="classified-listing"),
)
ROW_DESCRIPTION = (Selector(tag="p"), Selector(cls="description"), Selector(cls="listing-description"))
ROW_DATE = (Selector(tag="time"), Selector(cls="date"), Selector(cls="listing-date"))


def listing_rows(pages: DataFrame, base: str, category_path: str, rules=LISTING_RULES, fallback: bool = True,
                 location: str = P.DEFAULT_COUNTRY, per_page: int = 20, html: str = "html") -> DataFrame:
    """Rows of listing pages by the first rule that finds any, at most `per_page` for each page.

    Pages without a row fall back to their first ten links below the category path.
    `date_posted` is NULL where the row carries no date.
    """
    keep = [c for c in pages.columns if c != html]
    items = listing_items(F.col(html), rules, ROW_DESCRIPTION, ROW_DATE, category_path if fallback else None, per_page, 10)
    rows = pages.select(*keep, F.posexplode(items).alias("_i", "_row"))
    row, nr = F.col("_row"), (F.col("_i") + 1).cast("string")
    href, anchor = row["href"], row["anchor"]
    rows = rows.select(
        *keep, row["is_row"].alias("_is_row"), (F.col("_i") + 1).cast("bigint").alias("row_no"),
        F.when(~row["is_row"], F.coalesce(blank_to_null(anchor), F.concat(F.lit("Job Listing "), nr)))
        .when(anchor.isNotNull(), anchor)
        .otherwise(F.coalesce(blank_to_null(row["text"]), F.concat(F.lit("Listing "), nr))).alias("_title"),
        F.when(anchor.isNull(), F.concat(F.lit(base), F.lit(category_path)))
        .when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)).alias("link_url"),
        row["description"].alias("_text"), blank_to_null(row["date"]).alias("_date"))
    title = F.col("_title")
    return rows.where(~F.col("_is_row") | (F.length(title) >= 3)).select(
        *keep, "row_no", ellipsis(title, 100).alias("title"), "link_url", F.col("_date").alias("date_posted"),
        F.lit(location).alias("location"), ellipsis(F.coalesce(blank_to_null(F.col("_text")), title), 200).alias("description"))


def city_table(spark: SparkSession, cities: dict[str, str]) -> DataFrame:
    """City names with the address of their listing page."""
    pairs = [F.lit(x) for pair in cities.items() for x in pair]
    return spark.range(1).select(F.explode(F.create_map(*pairs)).alias("city", "url"))


def city_listing(links: DataFrame, cities: dict[str, str], base: str, unique: bool = False,
                 limit: int | None = None) -> DataFrame:
    """Postings read off city listing pages: link, title and what the enclosing row says.

    `links` come from `extract_links` and carry the page address as `url`. `unique` keeps each job id once over all
    cities, the first in order of the cities and of their pages (rows without an id count as one id, as a search for
    equal ids has it); `limit` takes so many rows in that order.
    """
    table = city_table(links.sparkSession, cities)
    tagged = posting_links(links.join(table, "url"), paths=(tags.POSTING_PATH,))
    once = dedup(tagged.withColumn("_key", F.concat_ws("\u0001", "city", "href")), "_key", ("page_id", "pos"),
                 null_key="collapse")
    row = F.col("parent_text")
    named = absolutize(once.drop("_key").withColumnRenamed("url", "page_url"), base)
    place = F.array_position(F.array(*[F.lit(c) for c in cities]), F.col("city"))
    named = named.withColumn("job_id", job_id(F.col("href"))).withColumn("_city", place)
    order = ("_city", "page_id", "pos")
    if unique:
        named = dedup(named, "job_id", order, null_key="collapse")
    if limit is not None:
        named = named.orderBy(*order).limit(limit)
    return named.select(
        "page_id", "pos", F.coalesce(blank_to_null(squeezed(F.col("title"))), F.lit("Job Listing")).alias("title"),
        "url", F.col("city").alias("location"), salary_phrase(row, "listing").alias("salary"),
        short_description(row).alias("description"),
        blank_to_null(tags.employment_type(row, P.EMPLOYMENT_5)).alias("employment_type"),
        tags.tag_skills(row, P.LISTING_SKILLS).alias("skills"), contact_loose(row).alias("contact"), "job_id")


def page_kind(df: DataFrame, url: str = "url") -> DataFrame:
    """`category` pages get a title from their path; postings are `job_detail`; others are dropped."""
    u = F.col(url)
    kind = (F.when(F.contains(u, F.lit(tags.CATEGORY_PATH)) & u.endswith("/jobs/"), "category")
            .when(F.contains(u, F.lit(tags.POSTING_PATH)), "job_detail"))
    named = F.when(F.col("type") == "category",
                   F.concat(F.lit(P.CATEGORY_TITLE), F.try_element_at(F.split(u, "/"), F.lit(-3))))
    return df.withColumn("type", kind).where(F.col("type").isNotNull()).withColumn("category_title", named)


def distinct_links(*frames: DataFrame) -> DataFrame:
    """Distinct union of the addresses of several link tables."""
    out = frames[0].select("url")
    for other in frames[1:]:
        out = out.unionByName(other.select("url"))
    return out.distinct()


