"""The walk over a page reads each tag once, and details are made in a few passes."""

import random
import re
import time

from pyspark.sql import functions as F

from jobsieve.functions import elements as E
from jobsieve.functions import fields as X

LINE = "Long shifts, night work and weekends may apply; meals are served on site"
BLOCKS = ("<table><tr><td><i>{}</i></td></tr></table>", "<div class='a listing-detail'><div><i>{}</i></div></div>", "<p class=detail-item><i>{}</i></p>")
PIECES = ("<div>", "</div>", "<p>", "</p>", "<p class='detail-item'>", "<table>", "<tr>", "<td>", "</table>", "<a href='/q?x=1&amp;y'>", "</a>",
          "<script>", "</script>", "<!--", "-->", "<", ">", "x", "&lt;", "&am", "p;", " ", "<br>", "<i>", "</i>", "< b>", "é", "<a <b>")


def test_a_walk_costs_little_more_than_finding_the_tags(spark):
    html = "".join(BLOCKS[i % 3].format(LINE) for i in range(60))
    found, walk = [], X.detail_pick()

    def seconds(f):
        best = 99
        for _ in range(7):
            start = time.perf_counter()
            for _ in range(40):
                f()
            best = min(best, time.perf_counter() - start)
        return best

    known = E.Tags() if hasattr(E, "Tags") else None
    parts = seconds(lambda: re.split("(<[^>]*>)", html))
    whole = seconds(lambda: found.append(len(walk.of(E.Page(html, known) if known is not None else E.Page(html)))))
    assert set(found) == {60}
    assert whole < 14 * parts, whole / parts


def test_kept_tags_change_nothing():
    pick, known = random.Random(5), E.Tags()
    known.SIZE = 8
    for _ in range(3000):
        html = "".join(pick.choice(PIECES) for _ in range(pick.randint(0, 20)))
        fresh, kept = E.Page(html), E.Page(html, known)
        assert [(e.name, e.attributes, e.start, e.stop) for e in fresh.elements] == [
            (e.name, e.attributes, e.start, e.stop) for e in kept.elements], html
        # With a comment in front, which is unseen, the pieces are found one by one.
        slow = E.Page("<!---->" + html)
        assert [(e.name, e.start, e.stop, e.parent.name) for e in slow.elements] == [
            (e.name, e.start, e.stop, e.parent.name) for e in fresh.elements] and slow.text == fresh.text, html


def test_details_of_odd_rows(spark):
    pick = random.Random(7)
    parts = (":", ":", " ", " ", "Key", "KEY", "a b", "é", "x" * 30, "y" * 120)
    pages = [["".join(pick.choice(parts) for _ in range(pick.randint(0, 6))) for _ in range(pick.randint(0, 8))] for _ in range(300)]
    pages += [[f"k{i % 900}: {i}" for i in range(1800)]]

    def plain(rows):
        out = {}
        for row in rows:
            if ":" in row:
                key, value = (x.strip("  ") for x in row.split(":")[:2])
                if key and value and len(key) < 50 and len(value) < 200:
                    out[re.sub("[  ]+", "_", key.lower())] = value
        return out

    df = spark.createDataFrame([(p,) for p in pages], "rows array<string>").coalesce(1)
    got = df.select(X.details_map(F.col("rows")).alias("m")).collect()
    assert [r.m for r in got] == [plain(p) for p in pages]
    assert df.select(X.details_map(F.lit(None).cast("array<string>")).alias("m")).first().m is None
