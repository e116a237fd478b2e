"""Classes of listing links and what is counted about them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.text import blank_to_null, half_up_ratio, percent_1, trimmed
from jobsieve.operators.keyed import dedup


def classify_links(links: DataFrame, mode: str = "strict", text: str = "parent_text") -> DataFrame:
    """Adds `link_class`. `strict` has three classes; `lenient` two, and drops links without text."""
    out = links.withColumn("link_class", tags.link_class(F.col(text), mode))
    return out.where(F.col("link_class").isNotNull()) if mode == "lenient" else out


def with_found_date(links: DataFrame, text: str = "parent_text") -> DataFrame:
    """Adds `found_date` and `has_date`."""
    out = links.withColumn("found_date", tags.found_date(F.col(text)))
    return out.withColumn("has_date", F.col("found_date").isNotNull())


def select_class(links: DataFrame, include_sponsored: bool = False, text: str = "parent_text",
                 order: Sequence[str] = ("page_no", "pos")) -> DataFrame:
    """Regular links, once per address; with `include_sponsored` also the sponsored ones, flagged."""
    flagged = links.withColumn("is_sponsored", tags.is_sponsored(F.col(text)))
    if not include_sponsored:
        return dedup(flagged.where(~F.col("is_sponsored")), "url", order, null_key="collapse")
    keyed = flagged.withColumn("_key", F.concat_ws("\u0001", F.col("is_sponsored").cast("string"), "url"))
    return dedup(keyed, "_key", order, null_key="collapse").drop("_key")


def union_classes(regular: DataFrame, sponsored: DataFrame) -> DataFrame:
    """Regular and sponsored postings in one table with a flag."""
    return (regular.withColumn("is_sponsored", F.lit(False))
            .unionByName(sponsored.withColumn("is_sponsored", F.lit(True))))


def _class_counts():
    c = F.col("link_class")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(c == "sponsored").alias("sponsored"),
        F.count_if(c == "regular").alias("regular"),
        F.count_if(c == "unknown").alias("unknown"),
    ]


def _per_page(links: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Class counts of every page. Links are counted by page first; pages of `pages` without links add zeros.

    Both parts are one row a page, so the second grouping moves little.
    """
    counts = links.groupBy("page_no").agg(*_class_counts())
    if pages is None:
        return counts
    names = counts.columns[1:]
    empty = pages.select("page_no", *[F.lit(0).cast("bigint").alias(c) for c in names])
    return counts.unionByName(empty).groupBy("page_no").agg(*[F.sum(c).alias(c) for c in names])


def page_breakdown(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Class counts of every page with the sponsored share.

    `pages` holds `page_no` of all pages visited; one without links counts 0. Without it only pages with links are known.
    """
    out = _per_page(links, pages)
    return out.withColumn("sponsored_pct", percent_1(F.col("sponsored"), F.col("total")))


def class_totals(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row: pages, class counts and the share of links that got a class. `pages`: see `page_breakdown`.

    Counts are taken per page first, so that counting pages needs no distinct over links.
    """
    out = _per_page(links, pages).agg(
        F.count(F.lit(1)).alias("pages_analyzed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "sponsored", "regular", "unknown")])
    return out.withColumn("classified_pct", percent_1(F.col("sponsored") + F.col("regular"), F.col("total")))


def breakdown_with_total(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per-page and overall counts in one job; the overall row has a NULL page. `pages`: see `page_breakdown`."""
    counts = _per_page(links, pages)
    out = counts.rollup("page_no").agg(*[F.sum(c).alias(c) for c in counts.columns[1:]])
    return out.withColumn("sponsored_pct", percent_1(F.col("sponsored"), F.col("total")))


def ending_patterns(links: DataFrame, text: str = "parent_text") -> DataFrame:
    """How often sponsored texts end in the same 20 characters and regular ones in the same `N units ago`."""
    clean = trimmed(F.col(text))
    ending = (F.when(F.col("link_class") == "sponsored", F.right(clean, F.lit(20)))
              .when(F.col("link_class") == "regular", blank_to_null(F.regexp_extract(clean, tags.AGO_ENDING, 0))))
    return (links.select("link_class", ending.alias("ending")).where(F.col("ending").isNotNull())
            .groupBy("link_class", "ending").agg(F.count(F.lit(1)).alias("n")))


def unknown_samples(links: DataFrame, text: str = "parent_text", per_page: int = 10, n: int = 20) -> DataFrame:
    """Report sample of unclassified texts: last 50 characters, first ten of each page, the first
    twenty different ones overall."""
    unknown = links.where(F.col("link_class") == "unknown").select(
        "page_no", "pos", F.right(trimmed(F.col(text)), F.lit(50)).alias("sample"))
    by_page = Window.partitionBy("page_no").orderBy("pos")
    first = unknown.withColumn("_rn", F.row_number().over(by_page)).where(F.col("_rn") <= per_page).drop("_rn")
    return dedup(first, "sample", ("page_no", "pos"), null_key="collapse").orderBy("page_no", "pos").limit(n)


def detailed_links(links: DataFrame, text: str = "parent_text", title: str = "title", url: str = "url") -> DataFrame:
    clean = trimmed(F.col(text))
    return links.select(
        "page_no", "pos", F.substring(F.col(title), 1, 80).alias("title"), F.col(url).alias("url"), "link_class",
        F.substring(clean, 1, 120).alias("parent_text"), tags.is_sponsored(clean).alias("is_sponsored"),
        tags.has_stamp(clean).alias("has_timestamp"))


def quality_band(totals: DataFrame) -> DataFrame:
    """Verdicts on a `class_totals` row."""
    pct = F.col("classified_pct")
    (least, best), (some, good), (_, rest) = P.REPORT_ACCURACY
    found, none = zip(P.REPORT_SPONSORED, P.REPORT_REGULAR)
    return totals.select(
        "*",
        F.when(F.col("sponsored") > 0, found[0]).otherwise(none[0]).alias("sponsored_detection"),
        F.when(F.col("regular") > 0, found[1]).otherwise(none[1]).alias("regular_detection"),
        F.when(pct > least, best).when(pct > some, good).otherwise(rest).alias("accuracy"),
        F.when(F.col("unknown") > 0, F.concat(F.col("unknown").cast("string"), F.lit(P.REPORT_UNKNOWN[0])))
        .otherwise(P.REPORT_UNKNOWN[1]).alias("unknown_jobs"))


def run_outcome(counts: DataFrame, processed: str = "processed", extracted: str = "extracted") -> DataFrame:
    """Failed count and whole-number success rate of one-row counts."""
    p, x = F.col(processed), F.col(extracted)
    return counts.select("*", (p - x).alias("failed"), half_up_ratio(x, p, 100).alias("success_rate"))
