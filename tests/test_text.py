"""Text helpers behave as the browser's functions do."""

from pyspark.sql import functions as F

from jobsieve.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first()["v"]


X = F.col("x")


def test_trim_strips_every_white_space(spark):
    assert one(spark, T.trimmed(X), x="\n\t\u00a0\u3000 a\u00a0b \r\n\ufeff") == "a\u00a0b"
    assert one(spark, T.squeezed(X), x=" a\n\n b\u00a0\u2003c d\te ") == "a b c d e"


def test_no_break_space_counts_as_space_in_patterns(spark):
    assert one(spark, F.regexp_extract(X, r"Salary:[\h\v]*(\d+)", 1), x="Salary:\u00a0450") == "450"


def test_first_match_and_keywords(spark):
    assert one(spark, T.first_match(X, [r"a(\d)", r"b(\d)"]), x="b1 a2") == "2"
    assert one(spark, T.first_match(X, [r"z(\d)"]), x="b1") == ""
    assert one(spark, T.first_keyword(X, ["x", "b"]), x="a b x") == "x"
    assert one(spark, T.first_keyword(X, ["q"]), x="a") is None


def test_contains_takes_wildcards_as_plain_text(spark):
    assert one(spark, T.contains_ci(X, "50%_A"), x="pay 50%_a more") is True
    assert one(spark, T.contains_ci(X, "%"), x="abc") is False


def test_numbers(spark):
    assert one(spark, T.digits_as_long(X), x="2000-3000 SAR") == 20003000
    assert one(spark, T.digits_as_long(X), x="none") is None
    assert one(spark, T.first_number(X), x="2000-3000 SAR") == 2000


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0), (2, 3), (1, 200)], "a bigint, b bigint")
    rows = df.select(T.percent_1(F.col("a"), F.col("b")), T.half_up_ratio(F.col("a"), F.col("b"), 100)).collect()
    assert [tuple(r) for r in rows] == [(12.5, 13), (33.3, 33), (0.0, 0), (66.7, 67), (0.5, 1)]


def test_last_newline_and_ellipsis(spark):
    assert one(spark, T.last_newline(X, 3), x="ab\ncd\n") == 2
    assert one(spark, T.last_newline(X, 5), x="ab\ncd\n") == 5
    assert one(spark, T.last_newline(X, 5), x="abcdef") == -1
    assert one(spark, T.ellipsis(X, 3), x="abcd") == "abc..."
    assert one(spark, T.ellipsis(X, 4), x="abcd") == "abcd"


def test_ascii_lower_keeps_positions(spark):
    for s in ("İstanbul BACK", "TEMP K Back", "ÄÖÜ Next"):
        low = one(spark, T.ascii_lower(X), x=s)
        assert len(low) == len(s)
    assert "k" not in one(spark, T.ascii_lower(X), x="K")


def test_last_line_value(spark):
    lines = T.text_lines(X)
    value = T.last_line_value(lines, lambda s: F.when(s.startswith("a"), s))
    assert one(spark, value, x="a1\n b \n  a2 \nc") == "a2"
    assert one(spark, value, x="b") is None


def test_comments_without_an_end_stay(spark):
    from jobsieve.functions.html import body_text

    pages = {"<!-- a --> x <!-- y <p>z": " x z", "a<!--b-->c<!--d-->e": "ace", "plain": "plain", "": ""}
    rows = spark.createDataFrame([(h,) for h in pages], "h string")
    got = {r["h"]: r["t"] for r in rows.select("h", body_text(F.col("h"), keep_scripts=True).alias("t")).collect()}
    assert got == pages
