"""Predicates and labels over link texts, titles and page texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.functions.bytewise import column, loose_employment
from jobsieve.functions.text import blank_to_null, contains_any, first_keyword, first_match, last_line_value, let, trimmed

# Endings and dates that tell the classes of listing links apart.
STAMP = r"\w{3}, \w{3} \d{1,2}, \d{4}, \d{1,2}:\d{2}:\d{2} [AP]M - (?:\d+ \w+ ago|an hour ago|a day ago)\z"
AGO_ENDING = r"\d+ \w+ ago\z"
FOUND_DATE_PATTERNS = (
    r"\d{1,2}/\d{1,2}/\d{4}",
    r"\d{1,2}-\d{1,2}-\d{4}",
    r"(?i)\d+ hours? ago",
    r"(?i)\d+ days? ago",
    r"(?i)(?:today|yesterday)",
    r"(?i)\w+ \d{1,2}, \d{4}",
    r"\d{2}:\d{2}",
)
SPONSORED_ENDING = "Sponsored"
POSTING_PATH = "/cls/"
CATEGORY_PATH = "/classifieds/"


def is_posting_url(href: Column, strict: bool = True, paths: Sequence[str] | None = None) -> Column:
    """Does the address lead to a posting?

    `strict` also asks for a run of eight digits; `paths` replaces the whole test by
    "contains one of these path parts".
    """
    if paths is not None:
        return contains_any(href, paths)
    test = F.contains(href, F.lit(POSTING_PATH)) & F.contains(href, F.lit(".html"))
    return test & F.regexp_like(href, F.lit(r"\d{8}")) if strict else test


def is_sponsored(text: Column) -> Column:
    return F.endswith(trimmed(text), F.lit(SPONSORED_ENDING))


def has_stamp(text: Column) -> Column:
    return F.regexp_like(trimmed(text), F.lit(STAMP))


def link_class(text: Column, mode: str = "strict") -> Column:
    """`strict`: sponsored, regular (time stamp ending) or unknown.
    `lenient`: sponsored or regular, NULL for a link without text."""
    clean = trimmed(text)
    sponsored = F.when(F.endswith(clean, F.lit(SPONSORED_ENDING)), "sponsored")
    if mode == "strict":
        return sponsored.when(F.regexp_like(clean, F.lit(STAMP)), "regular").otherwise("unknown")
    if mode == "lenient":
        return sponsored.when(clean != "", "regular")
    raise ValueError(f"unknown mode {mode!r}")


def found_date(text: Column) -> Column:
    """Time stamp ending, else the first date pattern that matches; NULL without a date."""
    return blank_to_null(first_match(trimmed(text), (STAMP, *FOUND_DATE_PATTERNS), 0))


def is_challenge(text: Column) -> Column:
    """Interstitial page instead of content."""
    return contains_any(F.lower(text), P.CHALLENGE_PHRASES)


def challenge_flag(title: Column, text: Column) -> Column:
    """Wider interstitial test, for data-quality columns."""
    return F.contains(F.lower(title), F.lit(P.CHALLENGE_TITLE)) | contains_any(F.lower(text), P.MORE_CHALLENGE_PHRASES)


def job_family(title: Column, families: Sequence[str] = P.JOB_FAMILIES) -> Column:
    return F.coalesce(first_keyword(F.lower(title), families), F.lit("other"))


def employment_type(text: Column, words: Sequence[str] = P.EMPLOYMENT_7) -> Column:
    """First keyword of the list that occurs; '' when none does."""
    return F.coalesce(let(F.lower(text), lambda low: first_keyword(low, words)), F.lit(""))


def employment_type_loose(text: Column) -> Column:
    """Leftmost keyword of the text, with an optional space or hyphen; '' when none occurs."""
    return column(loose_employment, F.lower(text))


def tag_skills(text: Column, words: Sequence[str] = P.SKILLS) -> Column:
    """All vocabulary terms that occur in the text, in vocabulary order."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    return let(F.lower(text), lambda low: F.filter(vocabulary, lambda w: F.contains(low, w)))


def detect_city(lines: Column, cities: Sequence[str] = P.CITIES) -> Column:
    """Capitalised city of the last line that names one; NULL when no line does."""
    return last_line_value(lines, lambda line: F.initcap(first_keyword(F.lower(line), cities)))
