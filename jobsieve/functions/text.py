r"""String helpers whose results equal those of the browser-side text functions.

Java regexes differ from ECMAScript ones in four places that matter here:
`\s` does not match the no-break space (`[\h\v]` does), `$` also matches before a
final newline (`\z` does not), `\b` is not ASCII-only on Java 17 (look-arounds
are), and `trim` in SQL removes spaces only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every white space character of the browser, as one string.
SPACES = (" \t\n\r\u000b\f\u00a0\u0085\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff"
          + "".join(chr(c) for c in range(0x2000, 0x200B)))


def trimmed(c: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def squeezed(c: Column) -> Column:
    """White space runs become one space, ends are stripped."""
    return F.trim(F.regexp_replace(c, r"[\h\v\x{FEFF}]{2,}|[\h\v\x{FEFF}&&[^ ]]", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def non_empty(c: Column) -> Column:
    """True for a present, non-empty string (blank-only text counts as present)."""
    return F.coalesce(c != "", F.lit(False))


def contains_ci(c: Column, term: str) -> Column:
    """Case-insensitive substring test; `%` and `_` in the term are plain characters."""
    return F.contains(F.lower(c), F.lit(term.lower()))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(c, F.lit(term))
    return test


def first_match(c: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Capture of the first pattern in the list that matches; '' when none does."""
    found = [blank_to_null(F.regexp_extract(c, p, group)) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower case of the same length, so that positions carry over to the original text.

    The two characters whose lower case would be longer or become an ASCII letter are masked.
    """
    masked = F.replace(F.replace(c, F.lit("\u0130"), F.lit("\u0001")), F.lit("\u212a"), F.lit("\u0001"))
    return F.lower(masked)


def earliest(c: Column, words: Sequence[str]) -> Column:
    """1-based position of the first of the words; length + 1 when none occurs."""
    # A test for the word costs a fraction of the search for its place.
    return F.least(*[F.when(F.contains(c, F.lit(w)), F.instr(c, w)) for w in words], F.length(c) + 1)


def first_keyword(lowered: Column, words: Sequence[str]) -> Column:
    """First word of the list, in list order, that occurs in the text; NULL when none does."""
    chain = None
    for word in words:
        test = F.contains(lowered, F.lit(word))
        chain = F.when(test, word) if chain is None else chain.when(test, word)
    return chain


def text_lines(c: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: x != "")


def last_line_value(lines: Column, value) -> Column:
    """`value(line)` of the last line for which it is not NULL; NULL when there is none."""
    hits = F.filter(F.transform(lines, value), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(-1))


def digits_as_long(c: Column) -> Column:
    """All digits of the text read as one number; NULL without digits."""
    return blank_to_null(F.regexp_replace(c, "[^0-9]", "")).try_cast("bigint")


def first_number(c: Column) -> Column:
    """The first run of digits read as a number; NULL without digits."""
    return blank_to_null(F.regexp_extract(c, "([0-9]+)", 1)).try_cast("bigint")


def digits_as_double(c: Column) -> Column:
    """All digits of the text as one number of any length, rounded as a DOUBLE is; NULL without digits."""
    return blank_to_null(F.regexp_replace(c, "[^0-9]", "")).try_cast("double")


def first_number_as_double(c: Column) -> Column:
    """The first run of digits as a number of any length; NULL without digits."""
    return blank_to_null(F.regexp_extract(c, "([0-9]+)", 1)).try_cast("double")


def half_up_ratio(part: Column, whole: Column, scale: int = 1) -> Column:
    """`scale * part / whole` rounded half up, in integer arithmetic; 0 for an empty whole.

    Exact for any counts up to the range of DECIMAL(38).
    """
    a, b = part.cast("decimal(38,0)"), whole.cast("decimal(38,0)")
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("div", a * (2 * scale) + b, F.nullif(b * 2, F.lit(0))).cast("bigint"))


def percent_1(part: Column, whole: Column) -> Column:
    """Percentage with one decimal as a DOUBLE, rounded half up; 0 for an empty whole."""
    return half_up_ratio(part, whole, 1000) / F.lit(10.0)


def ellipsis(c: Column, n: int) -> Column:
    """First n characters plus `...` when the text is longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def last_newline(c: Column, n: int) -> Column:
    """0-based position of the last newline at or before position n; -1 without one."""
    def place(head):
        return let(F.instr(F.reverse(head), "\n"), lambda back: F.when(back == 0, -1).otherwise(F.length(head) - back))
    return let(F.substring(c, 1, n + 1), place)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with milliseconds and Z (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
