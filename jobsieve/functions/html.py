"""Text of a page snapshot, by native expressions over the HTML column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions.text import let, squeezed

# Named characters decoded in page text; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
UNSEEN = r"(?is)<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<!--.*?-->"
# The same, and what stands behind the first opening without an end is kept as group 1.
UNSEEN_OR_REST = UNSEEN + r"|((?:<script[^>]*>|<style[^>]*>|<!--).*)"
OPENING = r"(?i)<(?:script|style|!--)"
MARK = "\ue000"           # stands behind the `<` of an opening without an end while ends are searched
# What stands behind an opening without an end is kept as group 1: if one has no end, no later one has.
COMMENTS = r"(?s)<!--.*?-->|(<!--.*)"
TAG = r"(?s)<[^>]*>"
HEAD = r"(?is)^.*?<body[^>]*>"


def decoded(c: Column) -> Column:
    out = c
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def without_tags(c: Column) -> Column:
    """Text content of a fragment: tags go, nothing is put in their place."""
    return let(F.regexp_replace(c, TAG, ""), decoded)


def _tags(c: Column, body) -> Column:
    """`body` of the text up to its last `>`, and the rest as it is: nothing there can be or end a tag."""
    return let(c, lambda t: let(F.substring_index(t, ">", -1), lambda rest: F.concat(
        body(F.substring(t, F.lit(1), F.length(t) - F.length(rest))), rest)))


def without_unseen(html: Column) -> Column:
    """Scripts, styles and comments removed.

    `html` ends with its last `>`. Most pages have no opening without an end, and one replacement does. In the others no
    opening of a kind has an end behind the last end of that kind; such openings are marked, so that the search for
    their ends is not made once for each.
    """
    def marked(c: Column, opening: str, closing: str) -> Column:
        return let(c, lambda t: let(F.length(F.regexp_extract(t, f"(?is)^.*{closing}", 0)), lambda n: F.concat(
            F.substring(t, F.lit(1), n), F.regexp_replace(F.substring(t, n + 1, F.length(t)), f"(?i)<(?={opening})", f"<{MARK}"))))

    def searched(c: Column) -> Column:
        for opening, closing in (("script", "</script"), ("style", "</style"), ("!--", "-->")):
            c = marked(c, opening, closing)
        return F.regexp_replace(F.regexp_replace(c, UNSEEN, ""), f"(?i)<{MARK}(?=script|style|!--)", "<")

    return let(html, lambda page: F.when(page.rlike(OPENING), let(
        F.regexp_replace(page, UNSEEN_OR_REST, "$1"), lambda out: F.when(
            out.rlike(OPENING), searched(page)).otherwise(out))).otherwise(page))


def body_text(html: Column, keep_scripts: bool = False) -> Column:
    """Text content of the body; script text only on request. Takes time in proportion to the page, whatever it holds."""
    def cleaned(page: Column) -> Column:
        return F.regexp_replace(page, COMMENTS, "$1") if keep_scripts else without_unseen(page)

    # Twice, because what is cleaned away may hold the last `>`.
    bare = _tags(_tags(html, cleaned), lambda page: F.regexp_replace(F.regexp_replace(page, HEAD, ""), TAG, ""))
    return let(bare, decoded)


def document_title(html: Column) -> Column:
    return squeezed(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
