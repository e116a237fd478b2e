"""Listing pages without a posting link stand in every part of the report that counts pages."""

from jobsieve.operators import classify as C
from jobsieve.plans.listing_report import listing_report, posting_link_table

BASE = "https://listings.example.com"
PAGES = [(1, '<ul><li><a href="/cls/60000001.html">Cook</a> Sponsored</li><li><a href="/cls/60000002.html">Nurse</a></li></ul>'),
         (2, '<ul><li><a href="/about">About</a></li></ul>'), (3, ""), (4, None)]


def test_pages_without_posting_links_count(spark):
    pages = spark.createDataFrame(PAGES, "page_no bigint, html string")
    links = posting_link_table(pages, BASE)
    report = listing_report(links, pages)
    want = [(1, 2, 1, 0, 1, 50.0), (2, 0, 0, 0, 0, 0.0), (3, 0, 0, 0, 0, 0.0), (4, 0, 0, 0, 0, 0.0)]
    assert sorted(map(tuple, report.page_breakdown.collect())) == want
    assert tuple(report.totals.first()) == (4, 2, 1, 0, 1, 50.0)
    rows = map(tuple, C.breakdown_with_total(links, pages).collect())
    assert sorted(rows, key=lambda r: r[0] or 0) == [(None, 2, 1, 0, 1, 50.0), *want]
    assert C.class_totals(links.limit(0), pages).first()["pages_analyzed"] == 4
