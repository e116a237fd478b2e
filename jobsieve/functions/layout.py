r"""The layout of a description, over Arrow batches.

Descriptions pass a dozen rules in order, most of which find nothing in a given text. Over the UTF-8 bytes a rule costs a
substring test where its words do not occur; as a chain of `regexp_replace` each rule reads and decodes the whole text.
Bytes also have the lower case that `(?i)` means: ASCII letters only, of the same length.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobsieve.functions import profile as P
from jobsieve.functions.text import SPACES

# What `[\h\v]` matches, in UTF-8: the white space of more than one byte, and all.
WIDE_SPACES = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_SPACE = rb"(?:[ \t-\r]|" + WIDE_SPACES + rb")"
_TAKEN = re.compile(_SPACE + rb"*")
# One look at the next byte settles most lines.
_BLANK_RUN = re.compile(rb"\n(?=[ \t-\r\xc2\xe1-\xe3])" + _SPACE + rb"*\n" + _SPACE + rb"*\n")
_BLANK_START = re.compile(_SPACE + rb"*\n+")
_BLANK_END = re.compile(rb"\n+" + _SPACE + rb"*\Z")
_NOISE = [(opening.encode(), re.compile(pattern.encode())) for opening, pattern in zip(P.NOISE_OPENINGS, P.NOISE_PATTERNS)]


def _rules(headings):
    """Lower-case words, what replaces them, and whether they take the white space behind them."""
    space = r"[\h\v]*"
    return [(pattern.removeprefix("(?i)").removesuffix(space).lower().encode(), new.encode(), pattern.endswith(space))
            for pattern, new in headings]


_SHORT, _LONG = _rules(P.SHORT_HEADINGS), _rules(P.LONG_HEADINGS)


def _visible(byte: int) -> bool:
    return 0x20 < byte < 0x7F


def trim(text: bytes) -> bytes:
    """Every kind of white space stripped at both ends."""
    if text and not (_visible(text[0]) and _visible(text[-1])):
        text = text.decode(errors="surrogateescape").strip(SPACES).encode(errors="surrogateescape")
    return text


def _calm(text: bytes) -> bytes:
    text = text.replace(b"\t", b" ")
    if b"  " in text:
        text = re.sub(rb" {2,}", b" ", text)
    return trim(_BLANK_RUN.sub(b"\n\n", text))


def _with_headings(text: bytes, rules) -> bytes:
    low = text.lower()
    for words, new, takes_space in rules:
        at, done, parts = low.find(words), 0, []
        if at < 0:
            continue
        while at >= 0:
            parts += (text[done:at], new)
            done = at + len(words)
            if takes_space:
                done = _TAKEN.match(text, done).end()
            at = low.find(words, done)
        text = b"".join((*parts, text[done:]))
        low = text.lower()
    return text


def _short(text: bytes) -> bytes:
    return _with_headings(_calm(text), _SHORT)


def laid_out(text: bytes) -> bytes:
    """The `long` form."""
    text = _calm(text)
    for opening, pattern in _NOISE:
        if opening in text:
            text = pattern.sub(b"", text)
    text = _BLANK_RUN.sub(b"\n\n", _with_headings(text, _LONG))
    start = _BLANK_START.match(text)
    if start:
        text = text[start.end():]
    return text if not text or _visible(text[-1]) else _BLANK_END.sub(b"", text)


def _batch(texts: pa.Array, rule) -> pa.Array:
    out = [None if t is None else rule(t) for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(out, pa.binary()).cast(pa.string(), safe=False)


def _short_batch(texts: pa.Array) -> pa.Array:
    return _batch(texts, _short)


def _long_batch(texts: pa.Array) -> pa.Array:
    return _batch(texts, laid_out)


def format_description(c: Column, style: str = "long") -> Column:
    """Calm white space, remove script noise (`long`), put section headings on their own lines."""
    return F.arrow_udf(_short_batch if style == "short" else _long_batch, StringType())(c)
