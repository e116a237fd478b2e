"""Texts are not searched for the places of words that they do not hold."""

import time

from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import profile as P
from jobsieve.functions.text import earliest, last_newline, let


def test_places_and_cuts(spark):
    df = spark.createDataFrame([("éaBackbNext",), ("none",), ("",), ("x\n" + "y" * 20,), (None,)], "t string")
    t = F.col("t")
    rows = df.select(earliest(t, ["Next", "Back"]).alias("at"), last_newline(t, 5).alias("cut"), X.truncate_text(t, 5, 0).alias("soft"),
                     X.truncate_text(t, 5, 3).alias("hard")).collect()
    assert [r.at for r in rows] == [3, 5, 1, 23, None] and [r.cut for r in rows] == [-1, -1, -1, 1, None]
    assert [r.soft for r in rows] == ["éaBac...", "none", "", "x" + P.CONTINUED, None]
    assert [r.hard for r in rows] == ["éaBac...", "none", "", "x\nyyy...", None]


def test_absent_words_cost_little(spark):
    """Each place was searched twice, and also that of a word that does not occur."""
    words = [f"word {i} that is not there" for i in range(12)]
    df = spark.range(40).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("Long shifts and © night work may apply "), 4000)).alias("t"))

    def plain(c, names):
        return F.least(*[F.nullif(F.instr(c, w), F.lit(0)) for w in names], F.length(c) + 1)

    def seconds(f):
        start = time.perf_counter()
        df.select(F.sum(let(F.col("t"), lambda t: f(t, words)))).collect()
        return time.perf_counter() - start

    took = {f: min(seconds(f) for _ in range(3)) for f in (plain, earliest)}
    assert took[earliest] < 0.7 * took[plain], took
