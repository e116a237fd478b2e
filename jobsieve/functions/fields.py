"""Posting fields as native columns. `text` is the page text, `lines` its trimmed lines."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions import bytewise as B
from jobsieve.functions import profile as P
from jobsieve.functions.elements import Pick, Selector
from jobsieve.functions.html import decoded
from jobsieve.functions.layout import format_description  # noqa: F401
from jobsieve.functions.tags import employment_type_loose
from jobsieve.functions.text import (
    blank_to_null, contains_any, earliest, ellipsis, first_keyword, first_match, last_line_value,
    last_newline, let, squeezed, trimmed,
)


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def _pick_longest(start: Column, candidates: Sequence[Column]) -> Column:
    """Fold over the candidates: a strictly longer one replaces the current text."""
    return F.reduce(F.array(*candidates), start,
                    lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


# --- titles -----------------------------------------------------------------

def without_site_suffix(c: Column, own_domain: str) -> Column:
    return F.regexp_replace(c, rf"(?i)[\h\v]*-[\h\v]*{_quoted(own_domain)}[^\n\r]*\z", "")


def clean_title(c: Column, own_domain: str) -> Column:
    """Page title without site suffix, leading `... Jobs, ` and trailing `, digits`."""
    bare = trimmed(without_site_suffix(c, own_domain))
    bare = F.regexp_replace(bare, r"\A[^\n\r]*?Jobs,[\h\v]*", "")
    return trimmed(F.regexp_replace(bare, r",[\h\v]*\d+\z", ""))


def title_fallback(title: Column, heading: Column, lines: Column, own_domain: str) -> Column:
    """Title, else the heading, else the first line of 6 to 99 characters; at least 3 characters count."""
    bare = trimmed(F.regexp_replace(without_site_suffix(title, own_domain), r"[\h\v]*\|[^\n\r]*\z", ""))
    head = blank_to_null(trimmed(heading))
    line = F.get(F.filter(lines, lambda x: F.length(x).between(6, 99)), 0)
    second = F.when(F.length(bare) < 3, F.coalesce(head, bare)).otherwise(bare)
    return F.when(F.length(second) < 3, F.coalesce(line, second)).otherwise(second)


def title_from_text(title: Column, text: Column) -> Column:
    """A phrase such as `Position: ...` replaces the title when it is longer."""
    return _pick_longest(title, [trimmed(F.regexp_extract(text, p, 1)) for p in P.CONTENT_TITLE_PATTERNS])


# --- salary, contact, identity, dates, place --------------------------------

def salary(text: Column, patterns: Sequence[str] = P.SALARY_PATTERNS) -> Column:
    return first_match(text, patterns)


def _salary_of_line(line: Column) -> Column:
    low = F.lower(line)
    due = contains_any(low, P.SALARY_LINE_WORDS) & (F.contains(line, F.lit(":")) | F.regexp_like(line, F.lit(r"\d")))
    value = F.coalesce(*[blank_to_null(F.regexp_extract(line, p, 1))
                         for p in (P.LINE_SALARY_LABELLED, P.LINE_SALARY_CURRENCY, P.LINE_SALARY_NUMBER)])
    return F.when(due, trimmed(value))


def salary_phrase(source: Column, rule: str = "listing") -> Column:
    """Salary as a phrase; NULL without one.

    `listing`: number with currency or period; `free`: text after a salary label;
    `line` (takes lines): value of the last salary line; `lines` takes the text they stand in.
    """
    if rule == "lines":
        return B.column(B.line_salary, source)
    if rule == "listing":
        return blank_to_null(trimmed(F.regexp_extract(source, P.LISTING_SALARY, 1)))
    if rule == "free":
        return blank_to_null(first_match(source, P.FREE_SALARY_PATTERNS))
    if rule == "line":
        return last_line_value(source, _salary_of_line)
    raise ValueError(f"unknown rule {rule!r}")


def _all_matches(text: Column, patterns: Sequence[str]) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns])


def contacts(text: Column, patterns: Sequence[str] = P.PHONE_PATTERNS) -> Column:
    """Every phone number, pattern by pattern, each once, joined by `, `."""
    return F.array_join(F.array_distinct(_all_matches(text, patterns)), ", ")


def contacts_loose(text: Column) -> Column:
    """As `contacts`, for numbers with blanks and hyphens inside."""
    found = F.transform(_all_matches(text, P.LOOSE_PHONES), trimmed)
    return F.array_join(F.array_distinct(found), ", ")


def contact_loose(text: Column) -> Column:
    """First loosely written phone number; NULL without one."""
    return blank_to_null(F.regexp_extract(text, P.LOOSE_PHONE, 0))


def contact_of_lines(lines: Column) -> Column:
    """Phone, else e-mail, of the last contact line that has one."""
    def value(line):
        found = F.coalesce(contact_loose(line), blank_to_null(F.regexp_extract(line, P.EMAIL_ADDRESS, 1)))
        return F.when(contains_any(F.lower(line), P.CONTACT_LINE_WORDS), found)
    return last_line_value(lines, value)


def email(text: Column, own_domain: str, patterns: Sequence[str] = P.EMAIL_PATTERNS) -> Column:
    """First pattern whose match is not an address of the listing site; '' without one."""
    def foreign(p):
        return let(F.regexp_extract(text, p, 1),
                   lambda m: F.when((m != "") & ~F.contains(m, F.lit(own_domain)), m))
    found = F.coalesce(*[foreign(p) for p in patterns], F.lit(""))
    # Texts without the sign are the rule; they need no regex.
    return F.when(F.contains(text, F.lit("@")), found).otherwise("")


def url_posting_id(url: Column) -> Column:
    return F.regexp_extract(url, P.URL_POSTING_ID, 1)


def job_id(url: Column) -> Column:
    """Digits after the posting path; NULL without them."""
    return blank_to_null(F.regexp_extract(url, P.URL_JOB_ID, 1))


def url_tail(url: Column) -> Column:
    """Last path segment without its extension."""
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\A(.*?)\.html", "$1")


def posting_id(text: Column, url: Column, patterns: Sequence[str] = P.POSTING_ID_PATTERNS) -> Column:
    return F.coalesce(blank_to_null(first_match(text, patterns)), url_posting_id(url))


def posted_date(text: Column, patterns: Sequence[str] = P.POSTED_DATE_PATTERNS) -> Column:
    return trimmed(first_match(text, patterns))


def posted_at(date_text: Column) -> Column:
    """Time of a written date such as `Sunday, Jun 29, 2025, 9:09:17 PM`; NULL when it is another form."""
    day_free = F.regexp_replace(date_text, r"\A[A-Za-z]+day, ", "")
    return F.try_to_timestamp(day_free, F.lit(P.POSTED_FORMAT)).cast("timestamp_ntz")


def datetime_of_page(html: Column) -> Column:
    """First `datetime` attribute or date element that holds a date; '' without one."""
    date_tag = (r"""(?is)(<[a-z][^>]*?(?:\sdatetime\s*=|\sclass\s*=\s*["'](?:[^"']*\s)?"""
                r"""(?:date|posted-date)(?:\s[^"']*)?["'])[^>]*>)([^<]*)""")
    hits = F.regexp_extract_all(html, F.lit(date_tag), F.lit(0))
    # The page is searched once; a tag ends with its first `>`.
    values = F.transform(hits, lambda hit: F.coalesce(
        blank_to_null(F.regexp_extract(F.substring_index(hit, ">", 1), r"""(?is)\sdatetime\s*=\s*["']([^"']*)["']""", 1)),
        decoded(F.substr(hit, F.instr(hit, ">") + 1))))
    dated = F.filter(values, lambda v: F.regexp_like(v, F.lit(r"\d{4}|\d{2}/\d{2}")))
    return F.coalesce(trimmed(F.get(dated, 0)), F.lit(""))


def location(text: Column, patterns: Sequence[str] = P.LOCATION_PATTERNS, default: str = "") -> Column:
    place = trimmed(first_match(text, patterns))
    return F.when(place == "", default).otherwise(place) if default else place


def category(text: Column) -> Column:
    return trimmed(F.regexp_extract(text, P.CATEGORY_PATTERN, 1))


# --- labelled lines and details ---------------------------------------------

def _labelled_value(line: Column, rule) -> Column:
    words, pattern, below = rule
    value = trimmed(F.regexp_extract(line, pattern, 1))
    due = contains_any(F.lower(line), words) & F.contains(line, F.lit(":")) & F.regexp_like(line, F.lit(pattern))
    return F.when(due & (F.length(value) < below), value)


def labelled(lines: Column, rule) -> Column:
    """Value of the last line with one of the rule's labels; NULL without one."""
    return last_line_value(lines, lambda line: _labelled_value(line, rule))


def labelled_in(text: Column, rule) -> Column:
    """`labelled` of the lines of a text."""
    return B.column(B.labelled(rule), text)


def location_in(text: Column, cities: Sequence[str] = P.CITIES) -> Column:
    """`line_location` of the lines of a text."""
    return B.column(B.line_location(P.LOCATION_LINE, cities), text)


def line_location(lines: Column, cities: Sequence[str] = P.CITIES) -> Column:
    """Last line that names a city or carries a location label; the city wins within a line."""
    def value(line):
        city = F.initcap(first_keyword(F.lower(line), cities))
        return F.coalesce(city, _labelled_value(line, P.LOCATION_LINE))
    return last_line_value(lines, value)


def labelled_lower(text: Column, label: str) -> Column:
    """Lower-cased text after a label, up to a full stop or line end; NULL without the label."""
    return B.column(B.behind_label(label), F.lower(text))


def details_map(rows: Column, text: Column | None = None) -> Column:
    """Map of `key: value` rows. Only the text between the first two colons is the value;
    a later row replaces the value of an earlier one. With `text`, the seven known labels
    found in the page text replace or extend the map."""
    def halves(row):
        return F.struct(trimmed(F.substring_index(row, ":", 1)).alias("k"),
                        trimmed(F.substring_index(F.substring_index(row, ":", 2), ":", -1)).alias("v"))

    def keep(e):
        return (e["k"] != "") & (e["v"] != "") & (F.length(e["k"]) < 50) & (F.length(e["v"]) < 200)

    def entry(e):
        return F.struct(F.regexp_replace(F.lower(e["k"]), r"[\h\v]+", "_").alias("k"), e["v"].alias("v"))

    # Pass by pass: what a lambda says twice is computed twice.
    halved = F.transform(F.filter(rows, lambda r: F.contains(r, F.lit(":"))), halves)
    entries = F.transform(F.filter(halved, keep), entry)
    if text is not None:
        known = [F.struct(F.lit(k).alias("k"), labelled_lower(text, k).alias("v")) for k in P.LOWER_LABELS]
        known.insert(4, F.struct(F.lit("employment_type").alias("k"),
                                 blank_to_null(employment_type_loose(text)).alias("v")))
        entries = F.concat(entries, F.filter(F.array(*known), lambda e: e["v"].isNotNull()))

    def last_of_each(found):
        columns = F.struct(F.array_distinct(found["k"]).alias("keys"), F.reverse(found["k"]).alias("k"), F.reverse(found["v"]).alias("v"))
        return let(columns, lambda c: F.map_from_arrays(c["keys"], F.transform(
            c["keys"], lambda k: F.get(c["v"], F.array_position(c["k"], k).cast("int") - 1))))
    return let(entries, last_of_each)


# --- sections ----------------------------------------------------------------

def rule_section(text: Column, rule) -> Column:
    """Section from the rule's opening to its earliest end; '' without the opening."""
    section = B.section_rule(rule)
    return B.column(lambda t: section(t, t.lower()), text)


def requirements(text: Column) -> Column:
    """First requirements section whose cleaned text has a sensible length."""
    return B.column(B.fitting_section(P.REQUIREMENTS_RULES, P.REQUIREMENTS_HEADING, P.REQUIREMENTS_BULLET, P.REQUIREMENTS_LENGTH), text, b"")


def benefits(text: Column) -> Column:
    return B.column(B.fitting_section(P.BENEFITS_RULES, P.BENEFITS_HEADING, P.BENEFITS_BULLET, P.BENEFITS_LENGTH), text, b"")


def capped_section(text: Column, rule, n: int = 300, flat: bool = False) -> Column:
    """Section as found, at most n characters; `flat` squeezes white space first."""
    return B.column(B.capped(rule, n, flat), text)


# --- description --------------------------------------------------------------

def _until_marker(c: Column, markers: Sequence[str]) -> Column:
    """Text before the earliest of the markers."""
    return let(c, lambda x: F.substr(x, F.lit(1), earliest(x, markers) - 1))


def description(text: Column, marker: str = P.DESCRIPTION_MARKER, marker_skip: int = 16,
                end_markers: Sequence[str] = P.END_MARKERS) -> Column:
    """Text after the marker up to the earliest end marker; '' without the marker."""
    def inner(start):
        after = F.substr(text, start + marker_skip)
        return F.when(start > 0, trimmed(_until_marker(after, end_markers))).otherwise("")
    return let(F.instr(text, marker), inner)


def full_description(text: Column, p: P.ExtractionProfile) -> Column:
    """Description by marker, then by content patterns, then between header and footer; laid out, at most 1,500 characters."""
    return B.column(B.full_description(p), text, b"")


def longest_description(current: Column, text: Column) -> Column:
    """Longest of the current text and the content patterns."""
    def batch(now: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(now.cast(pa.binary()).to_pylist(), texts.cast(pa.binary()).to_pylist())
        return pa.array([c if c is None or t is None else B.longest(c, t) for c, t in rows], pa.binary()).cast(pa.string(), safe=False)
    return F.arrow_udf(batch, "string")(current, text)


def between_header_and_footer(text: Column) -> Column:
    """Text between the page header and footer when it is over 100 characters; NULL otherwise."""
    return B.column(B.between_marks, text)


def short_description_format(c: Column) -> Column:
    """As `format_description(c, "short")`, in native columns: the short record is made without Python."""
    # Single blanks are what the rule leaves, so they need no replacement.
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    c = trimmed(F.regexp_replace(c, r"\n[\h\v]*\n[\h\v]*\n", "\n\n"))
    for pattern, heading in P.SHORT_HEADINGS:
        c = F.regexp_replace(c, pattern, heading)
    return c


def truncate_text(c: Column, n: int, soft_min: int | None = None) -> Column:
    """First n characters plus `...`; with `soft_min`, cut at the last newline beyond it."""
    if soft_min is None:
        return ellipsis(c, n)

    def softly(x):
        return let(last_newline(x, n), lambda cut: F.when(
            cut > soft_min, F.concat(F.substr(x, F.lit(1), cut), F.lit(P.CONTINUED))).otherwise(ellipsis(x, n)))
    return let(c, lambda x: F.when(F.length(x) > n, softly(x)).otherwise(x))


# --- blocks of the page ---------------------------------------------------------

# Block rules in order of preference.
TITLE_BLOCKS = (
    Selector(tag="h1"),
    Selector(cls="listing-title"),
    Selector(cls="job-title"),
    Selector(cls="classified-title"),
    Selector(part="title"),
)
DESCRIPTION_BLOCKS = (
    Selector(cls="listing-description"),
    Selector(cls="job-description"),
    Selector(cls="classified-description"),
    Selector(cls="description"),
    Selector(part="description"),
    Selector(cls="listing-body"),
    Selector(cls="content"),
    Selector(tag="p"),
)
CONTENT_BLOCKS = (
    Selector(cls="listing-content"),
    Selector(cls="classified-content"),
    Selector(cls="job-content"),
    Selector(cls="content"),
    Selector(cls="main-content"),
    Selector(id="content"),
    Selector(tag="main"),
    Selector(cls="container"),
)
TABLE_BLOCK = Selector(tag="table")
DETAIL_ROWS = (
    Selector(cls="listing-detail"),
    Selector(cls="detail-item"),
    Selector(tag="tr"),
)


def title_pick(rules=TITLE_BLOCKS) -> Pick:
    """First element of the first rule whose first element has text."""
    return Pick(tuple(rules), "first")


def block_pick(rules=DESCRIPTION_BLOCKS, over: int = 50) -> Pick:
    """First block of more than `over` characters, rule by rule."""
    return Pick(tuple(rules), "over", over)


def block_picks(rules=CONTENT_BLOCKS, over: int = 100) -> dict[str, Pick]:
    """Longest table, and longest content block, of more than `over` characters, squeezed; `longest_block` takes one of them."""
    return {"table": Pick((TABLE_BLOCK,), "longest", over, flat=True), "content": Pick(tuple(rules), "longest", over, flat=True)}


def detail_pick(rules=DETAIL_ROWS) -> Pick:
    """Rows of details by any rule, in document order."""
    return Pick(tuple(rules), "all")


def longest_block(parts: Column) -> Column:
    """Longest table, else the longest content block; '' without one. `parts`: see `block_picks`."""
    return F.coalesce(parts["table"], parts["content"], F.lit(""))


def short_description(text: Column, over: int = 50, n: int = 200) -> Column:
    """Squeezed text cut at n characters when it is longer than `over`; '' otherwise."""
    flat = squeezed(text)
    return F.when(F.length(flat) > over, ellipsis(flat, n)).otherwise("")


def page_description(text: Column, own_host: str, over: int = 100, n: int = 500) -> Column:
    """Squeezed page text up to an interstitial phrase or the site's own host name, cut at n characters."""
    def shown(flat):
        return F.when(F.length(flat) > over, ellipsis(flat, n)).otherwise("")
    return let(squeezed(text), lambda flat: let(
        F.substr(flat, F.lit(1), earliest(flat, [P.CHALLENGE_OPENING, own_host]) - 1), shown))


def preview(text: Column, n: int = 1000) -> Column:
    return F.substring(text, 1, n)
