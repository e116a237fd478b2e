"""Counts and statistics over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.text import blank_to_null, non_empty, trimmed
from jobsieve.operators.query import salary_digits, salary_size
from jobsieve.session import checkpointed

COVERAGE_FIELDS = (
    "salary", "contact", "email", "location", "description", "posted_date", "requirements", "benefits",
)
# Order statistics are found so many decimal digits at a time, sums in chunks of so many.
STEP = 6
CHUNK = 15


def _present(name: str) -> Column:
    return F.coalesce(trimmed(F.col(name)) != "", F.lit(False))


def _location() -> Column:
    return F.coalesce(blank_to_null(F.col("location")), F.lit("Unknown"))


def _salary_digits(mode: str = "all_digits") -> Column:
    """Digits of a salary above 0 without leading zeros, however many; NULL for any other text."""
    return blank_to_null(F.ltrim(salary_digits(mode), F.lit("0")))


def posting_counts(df: DataFrame) -> DataFrame:
    """One row: all, with a salary above 0, with contact, with e-mail, sponsored."""
    return df.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(salary_size() > 0).alias("jobs_with_salary"),
        F.count_if(_present("contact")).alias("jobs_with_contact"),
        F.count_if(_present("email")).alias("jobs_with_email"),
        F.count_if(F.col("is_sponsored") == "Yes").alias("sponsored_jobs"))


def location_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(_location().alias("location")).agg(F.count(F.lit(1)).alias("n"))


def top_locations(df: DataFrame, k: int = 10) -> DataFrame:
    """The k locations with most postings; ties by name."""
    return location_counts(df).orderBy(F.desc("n"), F.asc("location")).limit(k)


def n_locations(df: DataFrame) -> DataFrame:
    """Number of different locations; a blank one counts as `Unknown`."""
    return location_counts(df).agg(F.count(F.lit(1)).alias("total_unique_locations"))


def _by_size() -> Column:
    """Numbers as digits without leading zeros stand in order of this."""
    return F.struct(F.length("v"), "v")


def upper_median(counts: DataFrame, total: int) -> str:
    """Element n/2 of the sorted list of numbers given as (`v`, `n`) counts, `v` in digits without leading zeros.

    First the length that holds the rank is found, then STEP digits at a time: each step counts the numbers that begin
    with the digits found so far by their next ones, at most 10 ** STEP rows, and moves on to those that hold the rank.
    No task ever sees more than such a histogram, however many and however long the values are.
    """
    running = Window.orderBy("d")

    def step(histogram: DataFrame, left: int) -> tuple:
        ranked = histogram.withColumn("upto", F.sum("n").over(running))
        row = ranked.where(F.col("upto") > left).orderBy("upto").first()
        return row["d"], left - (row["upto"] - row["n"])

    size, left = step(counts.groupBy(F.length("v").alias("d")).agg(F.sum("n").alias("n")), total // 2)
    found = ""
    counts = counts.where(F.length("v") == size)
    while len(found) < size:
        digits = F.substring("v", len(found) + 1, STEP).alias("d")
        here = counts.where(F.startswith("v", F.lit(found))) if found else counts
        part, left = step(here.groupBy(digits).agg(F.sum("n").alias("n")), left)
        found += part
    return found


def _exact_sum(counts: DataFrame) -> int:
    """Sum of `v` times `n`, exact for any number of digits: sums of chunks, one row for each place of a chunk."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("v") - 1) / CHUNK).cast("int")),
        lambda k: F.right(F.substr("v", F.lit(1), F.length("v") - k * CHUNK), F.lit(CHUNK)).cast("decimal(20,0)"))
    sums = (counts.select("n", F.posexplode(chunks).alias("k", "part")).groupBy("k")
            .agg(F.sum((F.col("part") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")).alias("s")))
    return sum(int(r["s"]) * 10 ** (CHUNK * r["k"]) for r in sums.collect())


def _number(digits: str) -> float:
    return float(digits)


def _salary_figures(counts: DataFrame) -> tuple[int, float, float, float, float] | None:
    """Count, least, greatest, upper median and rounded mean of (`v`, `n`) counts; None without any."""
    base = counts.agg(F.sum("n").alias("count"), F.min(_by_size())["v"].alias("min"), F.max(_by_size())["v"].alias("max")).first()
    count = base["count"]
    if not count:
        return None
    mean = (2 * _exact_sum(counts) + count) // (2 * count)
    return count, _number(base["min"]), _number(base["max"]), _number(upper_median(counts, count)), _number(str(mean))


_FIGURES = "count bigint, min double, max double, median double, average double"


def salary_stats(df: DataFrame, mode: str = "all_digits") -> DataFrame:
    """Count, least, greatest, upper median and rounded mean of the salaries above 0, of any number of digits.

    No row when there is no salary. The median is the element at position n/2 of the sorted list (the upper one of two
    middle values); the mean is rounded half up. Order and sum are exact; the figures are given as the nearest DOUBLE,
    so that numbers beyond BIGINT stand beside the others. The postings are read once, when this is called: the counts
    by value are checkpointed, and single rows reach the driver from there.
    """
    counts = checkpointed(df.select(_salary_digits(mode).alias("v")).where(F.col("v").isNotNull())
                          .groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    figures = _salary_figures(counts)
    return df.sparkSession.createDataFrame([figures] if figures else [], _FIGURES)


def contact_methods(df: DataFrame) -> DataFrame:
    """Postings by way of contact: phone, email, both, neither."""
    phone, mail = _present("contact"), _present("email")
    method = F.when(phone & mail, "both").when(phone, "phone").when(mail, "email").otherwise("neither")
    return df.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))


def posting_sets(df: DataFrame) -> DataFrame:
    """Counts by location, by salary and by flags in one pass over the postings (`part` tells which)."""
    flags = ["has_contact", "has_email", "sponsored"]
    rows = df.select(_location().alias("location"), _salary_digits().alias("v"), _present("contact").alias("has_contact"),
                     _present("email").alias("has_email"), F.coalesce(F.col("is_sponsored") == "Yes", F.lit(False)).alias("sponsored"))
    sets = rows.groupingSets([["location"], ["v"], flags], "location", "v", *flags).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("location").alias("_l"), F.grouping("v").alias("_v"))
    part = F.when(F.col("_l") == 0, "location").when(F.col("_v") == 0, "salary").otherwise("flags")
    return sets.select(part.alias("part"), "location", "v", *flags, "n")


def export_stats(df: DataFrame, k: int = 10) -> DataFrame:
    """All statistics of an export as one row of structs.

    Every part is an aggregate of `posting_sets`, which is checkpointed when this is called, so the postings are read
    once, and what is kept grows with the different locations and salaries, not with their combinations.
    """
    sets = checkpointed(posting_sets(df))
    n, part = F.col("n"), F.col("part")

    def rows(test):
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    phone, mail = F.col("has_contact"), F.col("has_email")
    flags = sets.where(part == "flags").agg(
        rows(F.lit(True)).alias("total_jobs"), rows(phone).alias("jobs_with_contact"), rows(mail).alias("jobs_with_email"),
        rows(F.col("sponsored")).alias("sponsored_jobs"), rows(phone & mail).alias("both"),
        rows(phone & ~mail).alias("phone"), rows(~phone & mail).alias("email"), rows(~phone & ~mail).alias("neither"))
    places = sets.where(part == "location")
    top = places.orderBy(F.desc("n"), F.asc("location")).limit(k).agg(
        F.sort_array(F.collect_list(F.struct((-n).alias("_o"), "location", n.alias("n")))).alias("t"))
    top = top.select(F.transform("t", lambda x: F.struct(x["location"].alias("location"), x["n"].alias("n")))).scalar()
    figures = _salary_figures(sets.where((part == "salary") & F.col("v").isNotNull()).select("v", "n"))
    count, least, most, median, mean = figures or (0, None, None, None, None)
    number = lambda x: F.lit(x).cast("double")
    with_salary = F.lit(count).cast("bigint")
    return flags.select(
        F.struct("total_jobs", with_salary.alias("jobs_with_salary"), "jobs_with_contact", "jobs_with_email",
                 "sponsored_jobs").alias("job_counts"),
        F.struct(places.agg(F.count(F.lit(1))).scalar().alias("total_unique_locations"),
                 top.alias("top_locations")).alias("locations"),
        F.struct(number(least).alias("min"), number(most).alias("max"), number(median).alias("median"),
                 number(mean).alias("average"), with_salary.alias("count")).alias("salary_analysis"),
        F.struct("phone", "email", "both", "neither").alias("contact_methods"))


def coverage(df: DataFrame, fields: Sequence[str] = COVERAGE_FIELDS, null_style: bool = False,
             list_fields: Sequence[str] = ()) -> DataFrame:
    """One row: all rows and, for each field, the rows that have it.

    A blank-only text counts as present. `null_style` is for records with NULL for missing
    values; `list_fields` count when they hold an element.
    """
    counts = [F.count_if(non_empty(F.col(f))).alias(f"with_{f}") for f in fields]
    counts += [F.count_if(F.coalesce(F.size(f) > 0, F.lit(False))).alias(f"with_{f}") for f in list_fields]
    first = "count" if null_style else "total_jobs"
    return df.agg(F.count(F.lit(1)).alias(first), *counts)


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    """Different non-empty values of a column."""
    return df.where(non_empty(F.col(name))).select(name).distinct()


def kind_summary(df: DataFrame) -> DataFrame:
    """One row: postings, category pages, rows with salary, with company, with an error."""
    return df.agg(
        F.count_if(F.col("type") == "job_detail").alias("job_details"),
        F.count_if(F.col("type") == "category").alias("categories"),
        F.count_if(non_empty(F.col("salary"))).alias("with_salary"),
        F.count_if(non_empty(F.col("company"))).alias("with_company"),
        F.count_if(non_empty(F.col("error"))).alias("errors"))


def split_counts(df: DataFrame, flag: str = "is_sponsored") -> DataFrame:
    """Postings by sponsored flag."""
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
