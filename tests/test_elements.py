"""The element walker: nested, unclosed and hostile markup; rows and links built on it."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobsieve.functions import elements as E
from jobsieve.functions import fields as X
from jobsieve.operators import links as L


def texts(html):
    page = E.Page(html)
    return [(e.name, page.text_of(e)) for e in page.elements]


def test_nested_elements_end_at_their_own_tag():
    assert texts("<div>a<div>b</div>c</div>d") == [("div", "abc"), ("div", "b")]
    assert texts("<DIV><span>x</SPAN></div>")[0] == ("div", "x")


def test_end_tags_may_be_missing():
    assert texts("<ul><li>a<li>b<b>c</ul>d") == [("ul", "abc"), ("li", "a"), ("li", "bc"), ("b", "c")]
    assert texts("<p>a<br>b<p>c<div>d</div>") == [("p", "ab"), ("br", ""), ("p", "c"), ("div", "d")]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == [
        ("table", "123"), ("tr", "12"), ("td", "1"), ("td", "2"), ("tr", "3"), ("td", "3")]
    assert texts("<ul><li>a<ul><li>b</ul>c<li>d</ul>")[1] == ("li", "abc")
    assert texts("</div>a</p><b>c") == [("b", "c")]


def test_unseen_and_odd_pages():
    assert texts("<div>a<script>'<b>'</script>b<!-- <i> -->c<style>p{}</STYLE>&amp;lt;</div>") == [("div", "abc&lt;")]
    assert texts(None) == [] and texts("") == [] and texts("<") == [] and texts("a < b <b>c") == []
    assert texts("<!-- <b>c</b>") == [] and texts("<script><b>c") == [("script", "c"), ("b", "c")]
    assert E.Page("<a class=x href='/q' href=2>t</a>").elements[0].attributes == {"class": "x", "href": "/q"}


def test_selectors():
    page = E.Page("<ul class='x listings'><li id=a>1</li></ul><ul><li class='big-listing'>2</li></ul>")
    li = E.Selector(tag="li", parent=E.Selector(tag="ul", cls="listings"))
    assert [e.get("id") for e in page.elements if li.fits(e)] == ["a"]
    assert [page.text_of(e) for e in page.elements if E.Selector(part="listing").fits(e)] == ["1", "2"]
    assert [page.text_of(e) for e in page.elements if E.Selector(id="a").fits(e)] == ["1"]


@pytest.mark.parametrize("opening", ["<!--", "<a ", "<script>", "<style>", "<p>", "<div>", "<li><b>", "<b></i>", "&amp;", "<!--<script><style>"])
def test_time_grows_with_the_length(opening):
    def took(n):
        best = 9
        for _ in range(3):
            start = time.process_time()
            E.Page(opening * (n // len(opening)))
            best = min(best, time.process_time() - start)
        return best

    assert took(400_000) < 8 * took(100_000) + 0.05


def test_many_anchors_in_one_element(spark):
    html = "<div>" + "".join(f"<a href='/cls/{i}.html'>Title {i}</a> words beside it " for i in range(2000)) + "</div>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    size = df.select(F.length(F.to_json(E.page_anchors(F.col("html"))))).first()[0]
    assert size < 10 * len(html)
    links = L.extract_links(df)
    assert links.count() == 2000 and links.select(F.countDistinct("parent_text")).first()[0] == 1
    assert links.where("length(parent_text) > 20000").count() == 2000


def test_parent_is_the_innermost_element(spark):
    html = "<div>far <table><tr><td>near <span>own <a href='/1'>one</a>!</span></td><td><a href='/2'>two</a></td></tr></table></div>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<a name=x>no</a>")], "page_id long, html string")
    assert [(r.href, r.title, r.parent_text) for r in L.extract_links(df).orderBy("pos").collect()] == [
        ("/1", "one", "own one!"), ("/2", "two", "two")]


def test_parts_of_a_page(spark):
    html = ("<div class='content'><div>Head</div>" + "body " * 30 + "</div><tr class=x><td>salary: 1</td></tr>"
            "<div class='listing-detail'><div>salary: 2</div></div><h1></h1><div class='job-title'>T</div>")
    df = spark.createDataFrame([(html,), (None,)], "html string")
    parts = E.page_parts(F.col("html"), title=X.title_pick(), rows=X.detail_pick(), **X.block_picks())
    rows = df.select(parts.alias("p")).select("p.*", X.longest_block(F.col("p")).alias("longest"),
                                              X.details_map(F.col("p.rows")).alias("details")).collect()
    assert rows[0].longest == "Head" + ("body " * 30).strip() and rows[0].title == "T"
    assert rows[0].details == {"salary": "2"} and rows[1].title is None and rows[1].rows == []


def test_rows_of_nested_elements(spark):
    row = ("<div class='listing-item'><div><a href='/cls/{0}.html'>Job <b>{0}</b></a></div><div class=description>Told <i>{0}</i></div>"
           "<span class='date'>1 July</span></div>")
    html = "<div>" + row.format(1) + "<a href='/out'>" + "<div class='listing-item'>inside an anchor</div></a>" + row.format(2) + "</div>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = L.listing_rows(df, "http://x", "/jobs/").orderBy("row_no").collect()
    assert [(r.title, r.link_url, r.description, r.date_posted) for r in rows] == [
        ("Job 1", "http://x/cls/1.html", "Told 1", "1 July"), ("inside an anchor", "http://x/out", "inside an anchor", None),
        ("Job 2", "http://x/cls/2.html", "Told 2", "1 July")]


def test_results_are_handed_on_in_short_stretches():
    """Before, what was found in a whole batch of up to 10,000 pages stood in memory at once."""
    walked = []
    batch = pa.array(["x" * (E.HANDED_ON // 2)] * 9 + [None])
    stretches = E.in_stretches(iter([batch, batch[:0]]), lambda page: walked.append(page) or len(walked), pa.int64())
    assert next(stretches).to_pylist() == [1, 2] and len(walked) == 2
    assert [x.to_pylist() for x in stretches] == [[3, 4], [5, 6], [7, 8], [9, 10], []]


def test_stretches_keep_pages_and_results_together(spark):
    item = "<li class='job-listing'><a href='/cls/{0}.html'>Job {0}</a></li>"
    pages = [(i, None if i % 5 == 4 else "<ul>" + item.format(i) * (i * 997 % 9000) + "</ul>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, html string").coalesce(1)
    links = {r.page_id: r for r in L.extract_links(df).groupBy("page_id").agg(
        F.count("*").alias("n"), F.min("title").alias("low"), F.max("title").alias("high")).collect()}
    for i, html in pages:
        n = html.count("<a ") if html else 0
        assert (i in links) == (n > 0) and (n == 0 or tuple(links[i]) == (i, n, f"Job {i}", f"Job {i}"))
    assert L.listing_rows(df, "http://x", "/jobs/").groupBy("page_id").count().agg(F.max("count")).first()[0] == 20
