from pyspark.sql import functions as F

from jobsieve.functions import tags
from jobsieve.operators import classify as C
from jobsieve.operators import links as L
from jobsieve.plans.daily import daily_run, regular_links
from jobsieve.plans.listing_report import listing_report, posting_link_table
from jobsieve.functions.profile import primary_profile

BASE = "https://listings.example.com"
HTML = """<html><body><script>var a = '<li><a href="/cls/11111111.html">x</a></li>';</script><!-- <a href="/no">n</a> -->
<ul><li><a class="t" href="/cls/60000001.html"><b>Driver</b> &amp; guide</a> Tue, Jul 1, 2025, 5:43:12 PM - 3 minutes ago</li>
<li><a href='/cls/60000002.html'>Cook</a> Sponsored</li><li><a href="/about">About</a></li>
<li><a href="/cls/60000003.html">Nurse</a> posted 1/7/2025</li></ul></body></html>"""


def pages(spark, n=1):
    return spark.createDataFrame([(i + 1, HTML) for i in range(n)], "page_no bigint, html string")


def test_extract_links(spark):
    rows = L.extract_links(pages(spark)).orderBy("pos").collect()
    assert [r["href"] for r in rows] == ["/cls/60000001.html", "/cls/60000002.html", "/about", "/cls/60000003.html"]
    assert rows[0]["title"] == "Driver & guide"
    assert rows[0]["parent_text"] == "Driver & guide Tue, Jul 1, 2025, 5:43:12 PM - 3 minutes ago"
    assert "html" not in rows[0].asDict()


def test_report_sums_up(spark):
    links = posting_link_table(pages(spark, 3), BASE)
    report = listing_report(links)
    totals = report.totals.first()
    assert totals["total"] == totals["sponsored"] + totals["regular"] + totals["unknown"] == links.count() == 9
    assert totals["pages_analyzed"] == 3 and totals["classified_pct"] == 66.7
    assert report.verdict.first()["accuracy"] == "Needs improvement"
    assert report.detailed.count() == 9 and report.unknown_samples.count() == 1


def test_empty_table_has_totals(spark):
    row = C.class_totals(posting_link_table(pages(spark).limit(0), BASE)).first()
    assert row["total"] == 0 and row["classified_pct"] == 0.0


def test_final_newline_is_not_an_ending(spark):
    df = spark.createDataFrame([("Job Sponsored\n",), ("Job Sponsored x",)], "parent_text string")
    assert [r[0] for r in df.select(tags.link_class(F.col("parent_text"))).collect()] == ["sponsored", "unknown"]


def test_until_empty_by_brute_force(spark):
    import random

    rng = random.Random(7)
    for run in (1, 2, 3):
        for _ in range(3):
            full = [rng.random() < 0.55 for _ in range(40)]
            links = spark.createDataFrame([(p + 1, 0) for p, f in enumerate(full) if f], "page_no bigint, pos bigint")
            frontier = spark.range(1, 41).select(F.col("id").alias("page_no"))
            stop, streak = 41, 0
            for p, f in enumerate(full):
                streak = 0 if f else streak + 1
                if streak == run:
                    stop = p + 1 - run + 1
                    break
            want = [p + 1 for p, f in enumerate(full) if f and p + 1 < stop]
            got = sorted(r["page_no"] for r in L.until_empty(links, frontier, run).collect())
            assert got == want


def test_listing_rows_rules_and_fallback(spark):
    rows_html = "<ul class='listings'>" + "".join(
        f"<li><a href='/cls/{i}.html'>Title {i}</a><p>Text {i}</p><time datetime='2025-07-0{i % 9 + 1}'>x</time></li>" for i in range(25)) + "</ul>"
    df = spark.createDataFrame([(1, rows_html), (2, "<a href='/jobs/1'></a><a href='/jobs/2'>Two</a><a href='/x'>no</a>")],
                               "page_id bigint, html string")
    rows = L.listing_rows(df, BASE, "/jobs/").orderBy("page_id", "row_no").collect()
    first = [r for r in rows if r["page_id"] == 1]
    assert len(first) == 20 and first[0]["title"] == "Title 0" and first[0]["date_posted"] == "2025-07-01"
    assert first[0]["description"] == "Text 0" and first[0]["link_url"] == BASE + "/cls/0.html"
    assert [r["title"] for r in rows if r["page_id"] == 2] == ["Job Listing 1", "Two"]
    assert L.listing_rows(df, BASE, "/jobs/", fallback=False).where("page_id = 2").count() == 0


def test_daily_run(spark):
    links = regular_links(pages(spark, 2), BASE)
    assert sorted(r["url"][-13:] for r in links.collect()) == ["60000001.html", "60000003.html"]
    detail = spark.createDataFrame(
        [(1, BASE + "/cls/60000001.html", "<title>A</title><body>Salary: 4000</body>"),
         (2, BASE + "/cls/60000003.html", "<title>B</title><body>Verify you are human</body>"),
         (3, BASE + "/cls/69999999.html", "<title>C</title><body>other</body>")], "page_id bigint, url string, html string")
    none = spark.createDataFrame([], "posting_id string")
    for backfill in (False, True):
        run = daily_run(links, detail, none, none, primary_profile("listings.example.com"), backfill=backfill, scraped_at="now")
        assert [r["posting_id"] for r in run.new_postings.collect()] == ["60000001"]
        assert run.summary().first().asDict() == {
            "new_jobs_found": 2, "already_seen": 0, "extracted": 1, "failed": 1, "success_rate": 50}
    seen = spark.createDataFrame([("60000001",)], "posting_id string")
    run = daily_run(links, detail, seen, none, primary_profile("listings.example.com"))
    assert run.skipped_links.count() == 1 and run.new_postings.count() == 0
