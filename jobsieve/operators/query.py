"""Filters, limits and batches over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions.text import (
    contains_ci, digits_as_double, digits_as_long, first_number, first_number_as_double, non_empty, trimmed)
from jobsieve.session import checkpointed

SEARCH_COLUMNS = ("title", "description", "company", "location")
FILE_ORDER = ("scraped_at", "posting_id", "url")


def search(df: DataFrame, term: str | None) -> DataFrame:
    """Rows with the term in title, description, company or location, in any case."""
    if not term:
        return df
    test = F.lit(False)
    for name in SEARCH_COLUMNS:
        if name in df.columns:
            test = test | contains_ci(F.col(name), term)
    return df.where(test)


def by_location(df: DataFrame, place: str | None) -> DataFrame:
    return df.where(contains_ci(F.col("location"), place)) if place else df


def salary_number(mode: str = "all_digits", name: str = "salary") -> Column:
    """Salary as a number. `all_digits` joins every digit of the text (`2000-3000` reads as
    20003000); `first_number` takes the first run of digits."""
    if mode == "all_digits":
        return digits_as_long(F.col(name))
    if mode == "first_number":
        return first_number(F.col(name))
    raise ValueError(f"unknown mode {mode!r}")


def salary_digits(mode: str = "all_digits", name: str = "salary") -> Column:
    """Digits of the salary as text; '' without any."""
    if mode == "all_digits":
        return F.regexp_replace(F.col(name), "[^0-9]", "")
    if mode == "first_number":
        return F.regexp_extract(F.col(name), "([0-9]+)", 1)
    raise ValueError(f"unknown mode {mode!r}")


def salary_size(mode: str = "all_digits", name: str = "salary") -> Column:
    """Salary for comparisons, with as many digits as the text has (`salary_number` ends at BIGINT)."""
    if mode == "all_digits":
        return digits_as_double(F.col(name))
    if mode == "first_number":
        return first_number_as_double(F.col(name))
    raise ValueError(f"unknown mode {mode!r}")


def min_salary(df: DataFrame, n: int | None, mode: str = "all_digits") -> DataFrame:
    """Salary of at least n. Rows with a blank salary stay, rows with words only go."""
    if not n:
        return df
    return df.where((trimmed(F.col("salary")) == "") | (salary_size(mode) >= n))


def checked_limit(n: int | None) -> int | None:
    if n is not None and n < 0:
        raise ValueError("limit must be 0 or more")
    return n


def effective_limit(limit: int | None = None, quick: bool = False, auto: bool = False,
                    max_rows: int | None = None) -> int | None:
    """Row limit of a run: the caller's, else the quick one (20 automatic, 15 otherwise), else the maximum."""
    if limit:
        return checked_limit(limit)
    if quick:
        return 20 if auto else 15
    return checked_limit(max_rows)


def first_rows(df: DataFrame, n: int | None, order: Sequence[str | Column] = FILE_ORDER) -> DataFrame:
    """First n rows in a stated order (a file has an order, a table has none)."""
    return df if checked_limit(n) is None else df.orderBy(*order).limit(n)


def filtered(df: DataFrame, term: str | None = None, place: str | None = None, salary_min: int | None = None,
             mode: str = "all_digits") -> DataFrame:
    return min_salary(by_location(search(df, term), place), salary_min, mode)


def latest_postings(df: DataFrame, term: str | None = None, place: str | None = None, salary_min: int | None = None,
                    limit: int | None = None, order: Sequence[str | Column] = FILE_ORDER) -> DataFrame:
    """All filters together, each optional, then the limit."""
    return first_rows(filtered(df, term, place, salary_min), limit, order)


def query_info(df: DataFrame, term: str | None = None, place: str | None = None, salary_min: int | None = None,
               limit: int | None = None) -> DataFrame:
    """One row about a query: rows in all, rows that match, rows returned, and the filters."""
    checked_limit(limit)
    match = F.lit(True)
    if term:
        hits = F.lit(False)
        for name in SEARCH_COLUMNS:
            if name in df.columns:
                hits = hits | contains_ci(F.col(name), term)
        match = match & hits
    if place:
        match = match & contains_ci(F.col("location"), place)
    if salary_min:
        match = match & ((trimmed(F.col("salary")) == "") | (salary_size() >= salary_min))
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(match).alias("matched_rows"))
    matched = F.col("matched_rows")
    returned = matched if limit is None else F.least(matched, F.lit(limit).cast("bigint"))
    return counts.select(
        "total_rows", "matched_rows", returned.alias("returned_rows"),
        F.lit(term).cast("string").alias("search"), F.lit(place).cast("string").alias("location"),
        F.lit(salary_min).cast("bigint").alias("salary_min"), F.lit(limit).cast("bigint").alias("row_limit"))


def with_contact(df: DataFrame) -> DataFrame:
    """Postings one can answer to."""
    return df.where(non_empty(F.col("contact")) | non_empty(F.col("email")))


def with_salary(df: DataFrame) -> DataFrame:
    return df.where(non_empty(F.col("salary")))


# --- slices of an ordered list ------------------------------------------------

def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """Adds the 0-based position of each row in the given order, which must tell rows apart.

    The sorted rows are checkpointed, so both readings of their partitions agree. Only
    one count per partition meets in a single task.
    """
    stored = checkpointed(df.orderBy(*order))
    part = F.spark_partition_id()
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = stored.select("*", part.alias("_part"), within.alias("_at"))
    # One row per partition of the sorted table: small by construction.
    out = rows.join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def with_batch_no(df: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """Adds the 1-based batch number of each row for batches of `size` rows."""
    out = with_position(df, order, "_pos")
    return out.withColumn("batch_no", F.floor(F.col("_pos") / F.lit(size)) + 1).drop("_pos")


def n_batches(df: DataFrame, size: int) -> DataFrame:
    """One row: rows and batches."""
    n = F.col("total_rows")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.call_function("div", n + (size - 1), F.lit(size)).cast("bigint").alias("batches"))


def batch(df: DataFrame, offset: int, size: int, order: Sequence[str | Column] = FILE_ORDER) -> DataFrame:
    """Rows offset .. offset+size-1 of the ordered list, in that order, which must tell rows apart.

    One way for all offsets: by row position, so no task gathers the rows before the slice.
    """
    stop = checked_limit(offset) + checked_limit(size)
    at = with_position(df, order, "_pos")
    return at.where((F.col("_pos") >= offset) & (F.col("_pos") < stop)).orderBy("_pos").drop("_pos")
