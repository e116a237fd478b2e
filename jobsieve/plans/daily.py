"""From listing pages to the new postings of a day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.profile import ExtractionProfile
from jobsieve.functions.text import half_up_ratio
from jobsieve.operators.classify import classify_links, union_classes
from jobsieve.operators.extract import extract_postings
from jobsieve.operators.keyed import filter_new, keep_matched, split_new
from jobsieve.operators.links import absolutize, dedup_links, extract_links, page_cap, posting_links, until_empty
from jobsieve.operators.query import first_rows
from jobsieve.session import checkpointed


def regular_links(listing_pages: DataFrame, base: str, max_pages: int | None = None, stop_at_empty: bool = False,
                  sponsored: bool = False) -> DataFrame:
    """Regular posting links of listing pages (with `page_no`), once per address.

    `stop_at_empty` ends the walk at the first page without a regular or sponsored link; the link table, narrow next to
    the pages, is then kept for the two looks at it when this is called. `sponsored` takes the sponsored links too, and
    `is_sponsored` tells them apart.
    """
    pages = listing_pages if max_pages is None else page_cap(listing_pages, max_pages)
    links = posting_links(extract_links(pages.select("page_no", "html")))
    links = classify_links(links, "lenient").where(F.col("link_class").isNotNull())
    if stop_at_empty:
        links = until_empty(checkpointed(links), pages.select("page_no").distinct())
    links = absolutize(links, base).drop("href")
    c = F.col("link_class")
    regular = dedup_links(links.where(c == "regular"))
    return union_classes(regular, dedup_links(links.where(c == "sponsored"))) if sponsored else regular


@dataclass
class DailyRun:
    """Lazy parts of a daily run."""

    new_links: DataFrame
    skipped_links: DataFrame
    postings: DataFrame
    new_postings: DataFrame

    def summary(self) -> DataFrame:
        """One row: new, skipped, extracted, failed and the success rate."""
        new = self.new_links.agg(F.count(F.lit(1)).alias("n")).scalar()
        skipped = self.skipped_links.agg(F.count(F.lit(1)).alias("n")).scalar()
        out = self.postings.agg(F.count(F.lit(1)).alias("extracted")).select(
            new.alias("new_jobs_found"), skipped.alias("already_seen"), "extracted")
        n, x = F.col("new_jobs_found"), F.col("extracted")
        return out.select("*", (n - x).alias("failed"), half_up_ratio(x, n, 100).alias("success_rate"))


def daily_run(links: DataFrame, detail_pages: DataFrame, seen: DataFrame, export: DataFrame,
              profile: ExtractionProfile, limit: int | None = None, scraped_at: Column | str | None = None,
              backfill: bool = False) -> DailyRun:
    """New postings of a day.

    Links already seen are dropped by their id before the detail pages are joined. `links`
    is a stored link table with each address once (see `regular_links`).

    A day's new links are few next to all pages: Spark broadcasts them and no text of a
    known posting is touched. In a `backfill` most pages are new: records are extracted
    first, so that the join shuffles short records instead of HTML.
    """
    new, skipped = split_new(links, seen)
    taken = first_rows(new, limit, ("page_no", "pos"))
    if backfill:
        postings = extract_postings(detail_pages, profile, scraped_at).join(taken.select("url"), "url")
    else:
        pages = keep_matched(detail_pages, F.col("url"), taken, "url")
        postings = extract_postings(pages, profile, scraped_at)
    return DailyRun(taken, skipped, postings, filter_new(postings, export))
