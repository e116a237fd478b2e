r"""Sections, lines and words of a text, over the UTF-8 bytes of Arrow batches.

Where a word stands is found by substring search in an ASCII lower case of the same length; regexes see single lines only.
As columns, each rule reads, decodes and lowers the whole text for itself, and what a lambda says twice is computed twice.
Look-ups go on from where the last one ended, so time is in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions import profile as P
from jobsieve.functions.layout import WIDE_SPACES, laid_out, trim
from jobsieve.functions.profile import ExtractionProfile, Opening

BULLET = "•".encode()
_WIDE = re.compile(rb"(?:" + WIDE_SPACES + rb"|\xef\xbb\xbf)")
_WIDE_STARTS = (b"\xc2\xa0", b"\xc2\x85", b"\xe1", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80", b"\xef\xbb\xbf")
_BULLET_START = re.compile(rb" *(?:[-*]|\xe2\x80\xa2) *")
_NUMBER_START = re.compile(rb" *[0-9]+\. *")
_LINE_END = re.compile(rb"[\n\r]|\xc2\x85|\xe2\x80[\xa8\xa9]")
# The characters whose lower case is or starts with an ASCII letter, and that lower case.
_KELVIN, _DOTTED_I = "\u212a".encode(), "\u0130".encode()
_K, _I = b"k", "i\u0307".encode()


def column(rule: Callable[[bytes], bytes | None], texts: Column, null: bytes | None = None) -> Column:
    """`rule` of every text; `null` for a NULL text."""
    def batch(found: pa.Array) -> pa.Array:
        out = [null if t is None else rule(t) for t in found.cast(pa.binary()).to_pylist()]
        return pa.array(out, pa.binary()).cast(pa.string(), safe=False)
    return F.arrow_udf(batch, "string")(texts)


def _words(words: Sequence[str]) -> tuple[bytes, ...]:
    return tuple(w.lower().encode() for w in words)


def _decoded(text: bytes) -> str:
    return text.decode(errors="surrogateescape")


def _encoded(text: str) -> bytes:
    return text.encode(errors="surrogateescape")


def length(text: bytes) -> int:
    """Number of characters."""
    return len(text) if text.isascii() else len(_decoded(text))


def between(text: bytes, low: int, high: int) -> bool:
    """Is the number of characters in the range? A character has one to four bytes."""
    size = len(text)
    return low <= size <= 4 * high and low <= length(text) <= high


def squeeze(text: bytes) -> bytes:
    """White space runs become one space, ends are stripped."""
    if not text.isascii() and any(x in text for x in _WIDE_STARTS):
        text = _WIDE.sub(b" ", text)
    return b" ".join(text.split())


def first_of(low: bytes, words: Sequence[bytes], at: int, stop: int | None = None) -> tuple[int, int]:
    """Place and length of the word that comes first; -1 when none occurs."""
    best, size = -1, 0
    stop = len(low) if stop is None else stop
    for w in words:
        place = low.find(w, at, stop)
        if place >= 0 and (best < 0 or place < best):
            best, size = place, len(w)
            stop = min(stop, place + max(map(len, words)))
    return best, size


def end_of(low: bytes, words: Sequence[bytes], at: int) -> int:
    """Place of the first of the words; the length when none occurs."""
    place = first_of(low, words, at)[0]
    return len(low) if place < 0 else place


# --- sections ---------------------------------------------------------------------------

def _opened(low: bytes, words, endings, on_line: bool) -> tuple[int, int]:
    """Where the opening starts and ends; -1 without it. See `profile.Opening`."""
    if not on_line:
        start, size = first_of(low, words, 0)
        if start < 0 or not endings:
            return start, start + size
        end, more = first_of(low, endings, start + size)
        return (start, end + more) if end >= 0 else (-1, -1)
    places = [low.find(w) for w in words]
    while True:
        start, size = min(((p, len(w)) for p, w in zip(places, words) if p >= 0), default=(-1, 0))
        if start < 0:
            return -1, -1
        stop = _LINE_END.search(low, start)
        at = stop.start() if stop else len(low)
        end, more = first_of(low, endings, start + size, at)
        if end >= 0:
            return start, end + more
        places = [low.find(w, at) if 0 <= p < at else p for p, w in zip(places, words)]


def _blank_line(low: bytes, at: int, stop: int) -> int:
    """First empty line before a letter; `stop` without one."""
    place = low.find(b"\n\n", at, stop)
    while place >= 0:
        if low[place + 2:place + 3].isalpha():
            return place
        place = low.find(b"\n\n", place + 1, stop)
    return stop


def section_rule(rule) -> Callable[[bytes, bytes], bytes]:
    """Section of a text and its lower case, from the rule's opening to its earliest end; empty without the opening."""
    opening, stops, blank_line = rule
    words, endings, ends = _words(opening.words), _words(opening.endings), _words(stops)

    def section(text: bytes, low: bytes) -> bytes:
        start, after = _opened(low, words, endings, opening.on_line)
        if start < 0:
            return b""
        stop = end_of(low, ends, after)
        if blank_line:
            stop = _blank_line(low, after, stop)
        return text[start:stop]
    return section


def _cleaned(found: bytes, heading: bytes, bullet: bytes) -> bytes:
    flat = squeeze(found)
    # The heading is removed once, at its first place, with a bullet before it.
    place = flat.lower().find(heading)
    if place >= 0:
        head, rest = flat[:place], flat[place + len(heading):].lstrip(b" ")
        bare = head.rstrip(b" ")
        flat = (bare.removesuffix(bullet) if bare.endswith(bullet) else head) + rest
    if bullet in flat:
        flat = flat.replace(bullet + b" ", bullet).replace(bullet, BULLET + b" ")
    start = _BULLET_START.match(flat) or _NUMBER_START.match(flat)
    return trim(BULLET + b" " + flat[start.end():] if start else flat)


def fitting_section(rules, heading: str, bullet: str, bounds) -> Callable[[bytes], bytes]:
    """First section of the rules whose cleaned text has a length within the bounds; empty without one."""
    sections, head, mark = [section_rule(r) for r in rules], heading.lower().encode(), bullet.encode()

    def fitting(text: bytes) -> bytes:
        low = text.lower()
        for section in sections:
            found = section(text, low)
            if found:
                clean = _cleaned(found, head, mark)
                if between(clean, *bounds):
                    return clean
        return b""
    return fitting


def capped(rule, n: int, flat: bool) -> Callable[[bytes], bytes]:
    """First n characters of a section, squeezed before or trimmed after."""
    section = section_rule((*rule, False))

    def cut(text: bytes) -> bytes:
        found = section(text, text.lower())
        if flat:
            found = squeeze(found)
        found = found[:4 * n]
        found = found[:n] if found.isascii() else _encoded(_decoded(found)[:n])
        return found if flat else trim(found)
    return cut


# --- description ------------------------------------------------------------------------

_DESCRIPTION_SECTIONS = [section_rule(r) for r in P.DESCRIPTION_RULES]
_STRETCH_ENDS = _words(P.LONG_STRETCH_ENDS)


def _forward(text: bytes, at: int, n: int) -> int:
    """The place n characters behind one."""
    while n > 0 and at < len(text):
        at += 1
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        n -= 1
    return at


def marked_description(marker: str, skip: int, end_markers: Sequence[str]) -> Callable[[bytes], bytes]:
    """Text behind the marker up to the earliest end marker; empty without the marker."""
    mark, ends = marker.encode(), tuple(m.encode() for m in end_markers)

    def description(text: bytes) -> bytes:
        at = text.find(mark)
        if at < 0:
            return b""
        at = _forward(text, at, skip)
        return trim(text[at:end_of(text, ends, at)])
    return description


def long_stretch(text: bytes, low: bytes) -> bytes:
    """First stretch of `P.LONG_STRETCH_LENGTH` or more characters without full stop, up to the last end word in it or the text's end."""
    n, start = P.LONG_STRETCH_LENGTH, 0
    while start <= len(text):
        stop = text.find(b".", start)
        if stop < 0:
            return text[start:] if length(text[start:]) >= n else b""
        if stop - start >= n:
            found = _up_to_end_word(text, low, start, stop, n)
            if found:
                return found
        start = stop + 1
    return b""


def _up_to_end_word(text: bytes, low: bytes, start: int, stop: int, n: int) -> bytes:
    end = max(low.rfind(w, start, stop) for w in _STRETCH_ENDS)
    return text[start:end] if end - start >= n and length(text[start:end]) >= n else b""


def longest(current: bytes, text: bytes) -> bytes:
    """Longest of the current text and the content patterns; the first of them where lengths are equal."""
    low, size = text.lower(), length(current)
    for found in (*(section(text, low) for section in _DESCRIPTION_SECTIONS), long_stretch(text, low)):
        if len(found) > size and (more := length(found)) > size:
            current, size = found, more
    return current


def between_marks(text: bytes) -> bytes | None:
    """Text between the page header and footer when it is over 100 characters."""
    at = 0
    for mark in _HEADER_ENDS:
        place = text.find(mark)
        if place > at:
            at = place + len(mark)
    inner = text[at:end_of(text, _FOOTER_STARTS, at)]
    return trim(inner) if len(inner) > 100 and length(inner) > 100 else None


_HEADER_ENDS = tuple(m.encode() for m in P.HEADER_END_MARKERS)
_FOOTER_STARTS = tuple(m.encode() for m in P.FOOTER_START_MARKERS)


def truncated(text: bytes, n: int, soft_min: int) -> bytes:
    """First n characters plus `...`, or up to the last newline beyond `soft_min`."""
    if len(text) <= n:
        return text
    chars = _decoded(text)
    if len(chars) <= n:
        return text
    cut = chars.rfind("\n", 0, n + 1)
    return _encoded(chars[:cut] + P.CONTINUED if cut > soft_min else chars[:n] + "...")


def full_description(p: ExtractionProfile) -> Callable[[bytes], bytes]:
    """By marker, then by content patterns, then between header and footer; laid out and cut."""
    by_marker = marked_description(p.marker, p.marker_skip, p.end_markers)

    def description(text: bytes) -> bytes:
        found = by_marker(text)
        if not between(found, 100, len(found)):
            found = longest(found, text)
        if length(found) < 50:
            inner = between_marks(text)
            found = found if inner is None else inner
        return truncated(laid_out(found), 1500, 1000)
    return description


# --- lines ------------------------------------------------------------------------------

def _java(pattern: str) -> re.Pattern:
    """A pattern of `profile.py` over the bytes of one line: white space classes, any character but line ends."""
    raw = pattern.removeprefix("(?i)").encode()
    raw = raw.replace(rb"(.+)", rb"((?:[^\n\r\xc2\xe2]|\xc2(?!\x85)|\xe2(?!\x80[\xa8\xa9]))+)")
    raw = re.sub(rb"\[\\h\\v([^\]]*)\]", lambda m: rb"(?:[ \t-\r" + m[1] + rb"]|" + WIDE_SPACES + rb")", raw)
    return re.compile(raw, re.I)


def _line_end(low: bytes, at: int) -> int:
    stop = low.find(b"\n", at)
    return len(low) if stop < 0 else stop


def lines_with(text: bytes, low: bytes, words: Sequence[bytes], colon: bool = True, after: int = -1) -> Iterator[bytes]:
    """Trimmed lines that hold one of the words, and a colon, from the last to the first one that starts behind `after`."""
    places = [low.rfind(w) for w in words]
    while True:
        place = max(places)
        if place <= after:
            return
        start, stop = low.rfind(b"\n", 0, place) + 1, _line_end(low, place)
        if start <= after:
            return
        if colon:
            last = low.rfind(b":", 0, stop)
            if last < start:
                if last < 0:
                    return
                # No line behind that of the last colon counts.
                stop = _line_end(low, last)
                places = [low.rfind(w, 0, stop) if p >= stop else p for p, w in zip(places, words)]
                continue
        yield trim(text[start:stop])
        places = [low.rfind(w, 0, start) if p >= start else p for p, w in zip(places, words)]


def _line_value(rule) -> Callable[[bytes], bytes | None]:
    _, pattern, below = rule
    search = _java(pattern).search

    def value(line: bytes) -> bytes | None:
        found = b":" in line and search(line)
        if not found:
            return None
        out = trim(found[1])
        return out if between(out, 0, below - 1) else None
    return value


def _last(lines: Iterator[bytes], value: Callable[[bytes], bytes | None]) -> bytes | None:
    for line in lines:
        found = value(line)
        if found is not None:
            return found
    return None


def labelled(rule) -> Callable[[bytes], bytes | None]:
    """Value of the last line with one of the rule's labels."""
    words, value = _words(rule[0]), _line_value(rule)
    return lambda text: _last(lines_with(text, text.lower(), words), value)


def _lower_for(words: Sequence[str]) -> Callable[[bytes], bytes]:
    """Lower case as far as the words can tell it from that of the whole of Unicode."""
    def lower(text: bytes) -> bytes:
        low = text.lower()
        if low.isascii():
            return low
        return low.replace(_KELVIN, _K).replace(_DOTTED_I, _I)

    if all(w.isascii() for w in words):
        return lower
    return lambda text: _encoded(_decoded(text).lower())


def line_location(rule, cities: Sequence[str]) -> Callable[[bytes], bytes | None]:
    """Last line that names a city or carries a location label; the city wins within a line."""
    names = [(c.encode(), " ".join(w[:1].upper() + w[1:].lower() for w in c.split(" ")).encode()) for c in cities]
    words, label, lower = _words(rule[0]), _line_value(rule), _lower_for(cities)
    plain = all(c.isascii() for c in cities)

    def value(line: bytes) -> bytes | None:
        low = lower(line)
        for city, shown in names:
            if city in low:
                return shown
        return label(line)

    def location(text: bytes) -> bytes | None:
        if plain and _KELVIN not in text and _DOTTED_I not in text:
            low = text.lower()
            place = max((low.rfind(c) for c, _ in names), default=-1)
            start = low.rfind(b"\n", 0, place) + 1 if place >= 0 else -1
            found = _last(lines_with(text, low, words, after=start), label)
            return value(text[start:_line_end(low, place)]) if found is None and place >= 0 else found
        return _last(map(trim, reversed(text.split(b"\n"))), value)
    return location


_SALARIES = [_java(p).search for p in (P.LINE_SALARY_LABELLED, P.LINE_SALARY_CURRENCY, P.LINE_SALARY_NUMBER)]
_SALARY_WORDS = _words(P.SALARY_LINE_WORDS)
_DIGIT = re.compile(rb"[0-9]")


def _salary_of_line(line: bytes) -> bytes | None:
    if b":" in line or _DIGIT.search(line):
        for search in _SALARIES:
            found = search(line)
            if found:
                return trim(found[1])
    return None


def line_salary(text: bytes) -> bytes | None:
    """Value of the last salary line."""
    return _last(lines_with(text, text.lower(), _SALARY_WORDS, colon=False), _salary_of_line)


# --- words ------------------------------------------------------------------------------

def first_word(words: Sequence[str]) -> Callable[[bytes], bytes]:
    """First word of the list, in list order, that occurs; empty when none does."""
    known, lower = [w.encode() for w in words], _lower_for(words)

    def first(text: bytes) -> bytes:
        low = lower(text)
        return next((w for w in known if w in low), b"")
    return first


def words_found(texts: Column, words: Sequence[str]) -> Column:
    """As `tags.tag_skills`: all words that occur in the text, in the order of the list."""
    known, lower = [(w.encode(), w) for w in words], _lower_for(words)

    def found(text: bytes) -> list[str]:
        low = lower(text)
        return [shown for w, shown in known if w in low]

    def batch(rows: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else found(t) for t in rows.cast(pa.binary()).to_pylist()], pa.list_(pa.string()))
    return F.arrow_udf(batch, "array<string>")(texts)


_SPACES_OR_COLONS = rb"(?:[ \t-\r:]|" + WIDE_SPACES + rb")+"
_BEHIND_LABEL = re.compile(_SPACES_OR_COLONS + rb"([^.\n]+)")
_TIME = re.compile(rb"(?:[-\x20\t-\r]|" + WIDE_SPACES + rb")?time")


def behind_label(label: str) -> Callable[[bytes], bytes | None]:
    """Text behind the label, up to a full stop or line end. Takes lower case."""
    word = label.encode()

    def value(low: bytes) -> bytes | None:
        at = low.find(word)
        while at >= 0:
            found = _BEHIND_LABEL.match(low, at + len(word))
            if found:
                return found[1]
            at = low.find(word, at + 1)
        return None
    return value


def loose_employment(low: bytes) -> bytes:
    """Leftmost match of `profile.EMPLOYMENT_LOOSE`; empty when none occurs. Takes lower case."""
    best, size = first_of(low, (b"contract", b"temporary", b"permanent"), 0)
    for word in (b"full", b"part"):
        at = low.find(word)
        while at >= 0 and (best < 0 or at < best):
            found = _TIME.match(low, at + 4)
            if found:
                best, size = at, found.end() - at
                break
            at = low.find(word, at + 1)
    return low[best:best + size] if best >= 0 else b""
