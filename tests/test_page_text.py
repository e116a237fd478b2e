"""Page text against the plain patterns, and in linear time on pages with unclosed openings."""

import re
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from jobsieve.functions import html as H

PIECES = ["<script>", "</script>", "<!--", "-->", "<STYLE a>", "</style x>", "<body>", "x<", "b>"]


def plain(page):
    page = re.sub(H.UNSEEN, "", page)
    return re.sub(H.TAG, "", re.sub(H.HEAD, "", page, count=1))


def test_against_plain_patterns(spark):
    pages = ["".join(f"{p}{i}" for i, p in enumerate(parts)) for n in range(4) for parts in product(PIECES, repeat=n)]
    pages += ["<!-->a", "<!-- <script> --> b </script> c", "</script</script", "<script <script>", "a <script>\U0001f600</SCRIPT >é<script>z"]
    rows = spark.createDataFrame([(p,) for p in pages], "html string").select("html", H.body_text(F.col("html")).alias("t")).collect()
    for r in rows:
        assert r.t == plain(r.html), r.html
    assert spark.createDataFrame([(None,)], "html string").select(H.body_text(F.col("html")).alias("t")).first().t is None


@pytest.mark.parametrize("piece", ["<script>", "<!-- >", "<style", "</script", "<body ", "<", "<script></style>", "<!--<script></script>"])
def test_time_grows_with_the_page(spark, piece):
    def seconds(size):
        page = piece * (size // len(piece))
        start = time.perf_counter()
        spark.createDataFrame([(page,)], "html string").select(F.length(H.body_text(F.col("html")))).collect()
        return time.perf_counter() - start

    seconds(1000)
    # Ten times the page; quadratic time would be a hundred times the first, minutes in all.
    assert seconds(1_000_000) < 20 * seconds(100_000) + 2
