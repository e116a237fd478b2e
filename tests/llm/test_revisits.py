"""Revisits against a plain loop, URL spellings, blocks, and the SQL of the query."""

import random

import pytest

from jobsieve.llm import revisits as R
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


def record(i, url, at, kind="response", etag=None, modified=None, digest=None, headers=None):
    return (i, url, at, kind, 200 if kind == "response" else 304, etag, modified, digest, headers or {})


def same(a, b):
    return a.removeprefix("W/") == b.removeprefix("W/")


def plain(rows, key):
    out = []
    for i, url, at, kind, _, etag, modified, digest, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and url is not None and at is not None and r[1] is not None
                   and r[2] is not None and key[r[1]] == key[url] and r[2] <= at]
        best = max(earlier, key=lambda r: (r[2], -r[0]), default=None)
        outcome, merged = "unresolved", None
        if best:
            outcome = "unchecked"
            for x, y, test in ((etag, best[5], same), (modified, best[6], str.__eq__), (digest, best[7], str.__eq__)):
                if x is not None and y is not None:
                    outcome = "resolved" if test(x, y) else "mismatch"
                    break
            if outcome == "resolved":
                merged = {k.lower(): v for k, v in best[8].items()}
                merged |= {k.lower(): v for k, v in headers.items() if k.lower() not in R.KEPT_HEADERS}
        out.append((i, best and best[0], outcome, merged))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [10, 1000, 10**9])
def test_against_plain_loop(spark, block):
    pick = random.Random(block)
    spellings = {"a": ["http://www.Host.com/p/", "https://host.com:443/p?utm_source=x#top", "HTTP://HOST.com/p/index.html"],
                 "b": ["http://host.com/p?b=2&a=1", "http://host.com/p?a=1&gclid=x&b=2"], "c": ["http://host.com/P"]}
    key = {u: k for k, us in spellings.items() for u in us}
    rows = []
    for i in range(300):
        kind = pick.choice(["response", "revisit", "revisit"])
        # Most captures are of one URL.
        url = pick.choice(spellings[pick.choice("aaaabc")])
        rows.append(record(i, url, pick.randrange(0, 3000), kind, pick.choice([None, '"x"', 'W/"x"', '"y"']),
                           pick.choice([None, "mon", "tue"]), pick.choice([None, "d", "e"]),
                           {"Date": str(i), "Content-Length": str(i), "X": "1"} if pick.random() < 0.9 else None))
    rows += [record(900, None, 5, "revisit"), record(901, "http://host.com/p", None, "revisit"), record(902, None, 1),
             record(903, "http://other.com", 7, "revisit"), record(904, "http://host.com/p", None)]
    key |= {"http://host.com/p": "a", "http://other.com": "d"}
    df = spark.createDataFrame(rows, R.RECORD).repartition(4)
    got = sorted(((r.record_id, r.response_id, r.outcome, r.headers) for r in R.resolve(df, block).collect()), key=str)
    norm = lambda v: sorted((*x[:3], sorted(x[3].items()) if x[3] is not None else None) for x in v)
    key_of = lambda x: (x[0],)
    assert sorted(map(str, norm(got))) == sorted(map(str, norm(plain(rows, key)))), key_of


def test_clashing_columns_and_repeats(spark):
    rows = [(*record(1, "u.com/a", 1, etag="e"), "x", 1), (*record(2, "u.com/a", 2, "revisit", "e"), "x", 1),
            (*record(2, "u.com/a", 2, "revisit", "e"), "x", 1)]
    df = spark.createDataFrame(rows, R.RECORD + ", outcome string, block int")
    found = R.resolve(df).collect()
    assert [r.outcome for r in found] == ["resolved"] * 2 and {r.response_id for r in found} == {1}
    assert R.resolve(df.limit(0)).count() == 0


def test_ties_blank_addresses_and_parameters(spark):
    rows = [record(5, "u.com/a", 1, etag="e"), record(3, "u.com/a", 1, etag="e"), record(7, "u.com/a", 1, "revisit", "e"),
            record(8, " ", 1, etag="e"), record(9, "", 2, "revisit", "e"), record(10, "u.com/a?ref=1", 1, etag="e"),
            record(11, "u.com/a?ref=2", 2, "revisit", "e"), record(12, "http://#x", 3, "revisit", "e")]
    found = {r.record_id: (r.url_key, r.response_id, r.outcome) for r in R.resolve(spark.createDataFrame(rows, R.RECORD)).collect()}
    assert found == {7: ("u.com/a", 3, "resolved"), 9: (None, None, "unresolved"), 11: ("u.com/a?ref=2", None, "unresolved"),
                     12: (None, None, "unresolved")}


def test_header_names_in_several_spellings(spark):
    rows = [record(1, "u.com", 1, etag="e", headers={"Vary": "a", "VARY": "b", "X": "1", "x": None}),
            record(2, "u.com", 2, "revisit", "e", headers={"Date": "1", "date": "2"})]
    (row,) = R.resolve(spark.createDataFrame(rows, R.RECORD)).collect()
    assert row.headers == {"vary": "b, a", "x": "1", "date": "1, 2"}


def test_status_decides(spark):
    rows = [(1, "u.com", 1, "response", 404, "e", None, None, {}), (2, "u.com", 2, "revisit", 304, "e", None, None, {})]
    assert R.resolve(spark.createDataFrame(rows, R.RECORD)).first().outcome == "unresolved"


def test_query_has_the_rows_of_its_sql(spark):
    run = lambda s, d: R.page_revisits(s.read.parquet(f"{d}/pages.parquet"))
    status, rows, _, note = compare(spark, connect(SF), SF, "op7", run, R.PAGE_REVISITS_SQL)
    assert status == "ok" and rows > 0, note


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "http://a.b/c", None), (None, "http://a.b/c", ""), (3, "", "y" * 300_000)],
                                  "page_id long, url string, html string")
    assert R.page_revisits(pages).count() == 9
    assert R.page_revisits(pages.limit(0)).count() == 0
