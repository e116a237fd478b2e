"""Report on how the links of listing pages fall into classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from jobsieve.operators import classify as C
from jobsieve.operators.links import absolutize, extract_links, page_cap, posting_links


@dataclass
class ListingReport:
    page_breakdown: DataFrame
    totals: DataFrame
    verdict: DataFrame
    endings: DataFrame
    unknown_samples: DataFrame
    detailed: DataFrame


def posting_link_table(pages: DataFrame, base: str, n_pages: int | None = None) -> DataFrame:
    """Classified posting links of listing pages. Store it before reporting: it is narrow, the pages are not."""
    taken = pages if n_pages is None else page_cap(pages, n_pages)
    links = absolutize(posting_links(extract_links(taken)), base)
    return C.classify_links(links.drop("href"), "strict")


def listing_report(links: DataFrame, pages: DataFrame | None = None) -> ListingReport:
    """All parts of the report over one classified link table.

    `pages` holds `page_no` of all pages visited, so that those without a posting link are counted too.
    """
    totals = C.class_totals(links, pages)
    return ListingReport(C.page_breakdown(links, pages), totals, C.quality_band(totals), C.ending_patterns(links),
                         C.unknown_samples(links), C.detailed_links(links))
