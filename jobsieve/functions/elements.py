"""Elements of a page with their depth, for what needs an element's own text: parents of anchors, blocks, listing rows.

SQL has no balanced matching, so the tags are walked by a small helper inside Arrow batches, in one pass over the HTML:
text is decoded once, and an element is a stretch of it. Everything downstream of the walk is plain columns.

End tags may be missing: a new `li`, `tr`, `td`, `p` and so on ends the open one, an end tag ends what was left open in
its element, and the page's end ends the rest. Stray end tags are passed over. Scripts, styles and comments are unseen.
NULL pages have no elements.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsieve.functions.bytewise import squeeze
from jobsieve.functions.html import ENTITIES
from jobsieve.functions.text import SPACES

# Fixed values of HTML: elements without content, and elements that end open ones (up to the nearest of the second set).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = ("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
           "pre section table ul").split()
_CELLS = frozenset(("td", "th", "table"))
ENDS = {name: ({"p"}, _CELLS | {"button"}) for name in _BLOCKS} | {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "a": ({"a"}, _CELLS),
    "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tr", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "tbody"}, {"table"})}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_OPENING = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAGS = re.compile("<([^>]*)>")
_NOT_BOUNDS = bytes(x for x in range(256) if x not in b"<>")
_UNSEEN_END = {"script": re.compile("</script[^>]*>", re.I), "style": re.compile("</style[^>]*>", re.I)}


def decoded(text: str) -> str:
    if "&" in text:
        for name, char in ENTITIES:
            text = text.replace(name, char)
    return text


class Tag:
    """What a tag says (`text` is what stands between `<` and `>`), read once: the elements of equal tags share it. `fits` has what picks found out about it."""
    __slots__ = ("name", "closing", "void", "unseen", "ended", "within", "attributes", "fits")

    def __init__(self, text: str, name: str):
        self.name, self.closing, self.void = name, text.startswith("/"), name in VOID
        self.unseen = name in _UNSEEN_END and not self.closing
        self.ended, self.within = ENDS.get(name, ((), ()))
        self.attributes: dict[str, str] = {}
        self.fits: dict[Pick, tuple[int, ...]] = {}
        if "=" in text and not self.closing:
            for m in _ATTRIBUTE.finditer(text):
                self.attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")


class Tags(dict):
    """Tags by their text, NULL for what has no name. Most tags of a page stand in it, and in others, many times."""
    SIZE, LONGEST = 4096, 256

    def __missing__(self, text: str) -> Tag | None:
        found = _NAME.match(text)
        tag = Tag(text, found[1].lower()) if found else None
        if len(text) <= self.LONGEST:
            if len(self) >= self.SIZE:
                self.clear()
            self[text] = tag
        return tag


class Element:
    __slots__ = ("tag", "parent", "start", "stop")

    def __init__(self, tag: Tag, parent: Element | None, start: int, stop: int):
        self.tag, self.parent, self.start, self.stop = tag, parent, start, stop

    @property
    def name(self) -> str:
        return self.tag.name

    @property
    def attributes(self) -> dict[str, str]:
        return self.tag.attributes

    def get(self, name: str) -> str | None:
        return self.tag.attributes.get(name)


_ROOT = Tag("", "")


@dataclass(frozen=True)
class Selector:
    """Test of an element; `part` is a piece of its class value, `parent` a test of its parent."""
    tag: str | None = None
    cls: str | None = None
    part: str | None = None
    id: str | None = None
    parent: Selector | None = None

    def fits_tag(self, tag: Tag) -> bool:
        if self.tag and tag.name != self.tag:
            return False
        value = tag.attributes.get("class")
        if self.cls and (value is None or self.cls not in value.split()):
            return False
        if self.part and (value is None or self.part not in value):
            return False
        return not self.id or tag.attributes.get("id") == self.id

    def fits_parent(self, e: Element) -> bool:
        return self.parent is None or e.parent is not None and self.parent.fits(e.parent)

    def fits(self, e: Element) -> bool:
        return self.fits_tag(e.tag) and self.fits_parent(e)


class Page:
    """The decoded `text`, and of each element, in order of the start tags, its tag, the stretch of text and the number of its parent.

    `known` keeps tags from page to page.
    """

    def __init__(self, html: str | None, known: Tags | None = None):
        known = Tags() if known is None else known
        null, html = html is None, html or ""
        parts, self._regular = _parts(html)
        self._regular = self._regular and not null
        tags = [*map(known.__getitem__, parts[1::2])]
        if any(t is not None and t.unseen for t in tags):
            parts, self._regular = _seen_parts(html), False
            tags = [*map(known.__getitem__, parts[1::2])]
        texts = parts[0::2]
        self._pieces = texts, tags
        if "&" in html:
            texts = [decoded(x) for x in texts]
        self.tags, self.starts, self.stops, self.parents = [], [], [], []
        starts, stops, parents = self.starts, self.stops, self.parents
        names, stack, opened, at = [""], [-1], defaultdict(int), 0
        for at, tag in zip(accumulate(map(len, texts)), tags):
            if tag is None:
                continue
            name = tag.name
            if tag.closing:
                if name == names[-1] or opened[name]:
                    while True:
                        stops[stack.pop()] = at
                        ended = names.pop()
                        opened[ended] -= 1
                        if ended == name:
                            break
                continue
            for x in tag.ended:
                if opened[x]:
                    _end_open(names, stack, stops, opened, tag, at)
                    break
            parents.append(stack[-1])
            if not tag.void:
                stack.append(len(starts))
                names.append(name)
                opened[name] += 1
            self.tags.append(tag)
            starts.append(at)
            stops.append(at)
        self.text = "".join(texts)
        for no in stack[1:]:
            stops[no] = len(self.text)

    def body_text(self) -> str | None:
        """As `html.body_text`, of a page whose every `<` and `>` bounds a tag and that has nothing unseen; NULL for others."""
        texts, tags = self._pieces
        named = [x for x in enumerate(tags) if x[1] is not None and x[1].name.startswith(("body", "script", "style"))]
        opening = [(i, x.name) for i, x in named if not x.closing]
        if not self._regular or any(not name.startswith("body") for _, name in opening):
            return None
        return decoded("".join(texts[opening[0][0] + 1:] if opening else texts))

    @cached_property
    def elements(self) -> list[Element]:
        root, out = Element(_ROOT, None, 0, len(self.text)), []
        for tag, start, stop, parent in zip(self.tags, self.starts, self.stops, self.parents):
            out.append(Element(tag, root if parent < 0 else out[parent], start, stop))
        return out

    def text_between(self, start: int, stop: int) -> str:
        text = self.text[start:stop]
        # Most texts have no white space at their ends.
        if text and " " < text[0] < "\x7f" and " " < text[-1] < "\x7f":
            return text
        return text.strip(SPACES)

    def text_of(self, e: Element) -> str:
        return self.text_between(e.start, e.stop)

    def inside(self, e: Element) -> Iterator[Element]:
        """Elements below e, in order. They follow it directly, up to the first one that is not below it."""
        at = self.elements.index(e)
        below = {id(e)}
        for x in self.elements[at + 1:]:
            if id(x.parent) not in below:
                return
            below.add(id(x))
            yield x


def _end_open(names: list[str], stack: list[int], stops: list[int], opened: dict[str, int], tag: Tag, at: int) -> None:
    """Ends the open elements that the tag ends, up to the nearest one it stands within."""
    for depth in range(len(stack) - 1, 0, -1):
        here = names[depth]
        if here in tag.ended:
            for no in stack[depth:]:
                stops[no] = at
            for name in names[depth:]:
                opened[name] -= 1
            del stack[depth:], names[depth:]
        elif here in tag.within:
            return


def _parts(html: str) -> tuple[list[str], bool]:
    """Text and what stands in tags by turns, text at both ends, and whether every `<` and `>` bounds a tag."""
    if "<!--" in html:
        return _seen_parts(html), False
    bounds = html.encode(errors="surrogatepass").translate(None, _NOT_BOUNDS)
    if bounds == b"<>" * (len(bounds) // 2):
        return html.replace(">", "<").split("<"), True
    # Behind the last `>` nothing can be a tag.
    end = html.rfind(">") + 1
    parts = _TAGS.split(html[:end])
    parts[-1] += html[end:]
    return parts, False


def _seen_parts(html: str) -> list[str]:
    """The same without comments, scripts and styles; a tag is empty where something was passed over."""
    return [x for tag, text in _pieces(html) for x in (tag[1:-1], text)][1:]


def _pieces(html: str) -> Iterator[tuple[str, str]]:
    """(tag, text behind it); the tag is empty where something without a name was passed over. Linear in the length."""
    at, size, ended = 0, len(html), set()
    tag = ""
    while True:
        low = html.find("<", at)
        if low < 0:
            yield tag, html[at:]
            return
        text, stop, found = html[at:low], -1, _OPENING.match(html, low)
        name = found[1].lower() if found else ""
        if html.startswith("<!--", low) and "!" not in ended:
            stop = html.find("-->", low + 4) + 2
            if stop < 2:
                ended.add("!")      # no later comment has an end either
                stop = -1
        close = html.find(">", low) if stop < 0 else stop
        if close < 0:
            yield tag, html[at:]
            return
        yield tag, text
        tag = html[low:close + 1] if name and stop < 0 else ""
        if name in _UNSEEN_END and html[low + 1] != "/" and name not in ended:
            end = _UNSEEN_END[name].search(html, close)
            if end:
                tag, close = "", end.end() - 1
            else:
                ended.add(name)
        at = close + 1
        if at > size:
            return


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("﻿", " ")).strip(SPACES)


# Fixed value: characters of HTML after which the results so far are handed on. A batch has up to 10,000 pages; what is
# found in all of them is never held as Python objects at once.
HANDED_ON = 1 << 20


def in_stretches(batches: Iterator[pa.Array], found: Callable[[str | None], object], arrow: pa.DataType) -> Iterator[pa.Array]:
    """`found` of every page, in the order of the pages; an array ends where its pages have `HANDED_ON` characters."""
    for batch in batches:
        rows, size = [], 0
        for x in batch:
            page = x.as_py()
            rows.append(found(page))
            size += len(page or "")
            if size >= HANDED_ON:
                yield pa.array(rows, arrow)
                rows, size = [], 0
        yield pa.array(rows, arrow)


def _walked(html: Column, kind: str, arrow: pa.DataType, found: Callable[[Page], object]) -> Column:
    """`found` of every page as a column; a task holds a batch's HTML and the results of a short stretch of it."""
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Tags()
        return in_stretches(batches, lambda text: found(Page(text, known)), arrow)

    return F.arrow_udf(walk, kind)(html)


# --- anchors -------------------------------------------------------------------------

ANCHORS = "parents array<string>, anchors array<struct<href:string,title:string,parent:int>>"
_ANCHORS = pa.struct({"parents": pa.list_(pa.string()), "anchors": pa.list_(pa.struct(
    {"href": pa.string(), "title": pa.string(), "parent": pa.int32()}))})


def _anchors(page: Page) -> dict:
    parents, out = {}, []
    for e in page.elements:
        if e.name == "a" and e.get("href") is not None:
            no = parents.setdefault(id(e.parent), (len(parents), e.parent))[0]
            out.append({"href": decoded(e.get("href")), "title": page.text_of(e), "parent": no})
    return {"parents": [page.text_of(p) for _, p in parents.values()], "anchors": out}


def page_anchors(html: Column) -> Column:
    """Anchors with an address, and the texts of their parent elements, each of which stands once."""
    return _walked(html, ANCHORS, _ANCHORS, _anchors)


# --- blocks --------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class Pick:
    """What to take from the elements of some rules: `first` with text of each rule's first element, `over` (the first of
    more than n characters, rule by rule), `longest` of more than n characters, or `all` that fit any rule, in order.
    `flat` squeezes the longest."""
    rules: tuple[Selector, ...]
    how: str
    n: int = 0
    flat: bool = False

    def _fitting(self, page: Page) -> Iterator[tuple[int, tuple[int, ...]]]:
        """Numbers of the elements whose tags fit rules, and of these rules; each tag is tested once."""
        for no, tag in enumerate(page.tags):
            rules = tag.fits.get(self)
            if rules is None:
                rules = tag.fits[self] = tuple(i for i, r in enumerate(self.rules) if r.fits_tag(tag))
            if rules:
                rules = tuple(i for i in rules if self.rules[i].parent is None or self.rules[i].fits_parent(page.elements[no]))
                if rules:
                    yield no, rules

    def of(self, page: Page) -> str | list[str] | None:
        starts, stops, text_between = page.starts, page.stops, page.text_between
        if self.how == "all":
            return [text_between(starts[no], stops[no]) for no, _ in self._fitting(page)]
        best, fitting = None, list(self._fitting(page))
        for i in range(len(self.rules)):
            for no, rules in fitting:
                if i not in rules:
                    continue
                text = text_between(starts[no], stops[no])
                if self.how == "first":
                    if text:
                        return text
                    break
                if len(text) > self.n:
                    if self.how == "over":
                        return text
                    if best is None or len(text) > len(best):
                        best = text
        return best if best is None or not self.flat else squeeze(best.encode(errors="surrogatepass")).decode(errors="surrogatepass")


class BodyText:
    """Taken as a pick: the page text, see `Page.body_text`."""
    how = "text"

    def of(self, page: Page) -> str | None:
        return page.body_text()


def page_parts(html: Column, **picks: Pick | BodyText) -> Column:
    """A struct with one field for each pick; the page is walked once for all of them."""
    kinds = ", ".join(f"{name} {'array<string>' if p.how == 'all' else 'string'}" for name, p in picks.items())
    arrow = pa.struct({name: pa.list_(pa.string()) if p.how == "all" else pa.string() for name, p in picks.items()})

    def parts(page: Page) -> dict:
        return {name: p.of(page) for name, p in picks.items()}

    return _walked(html, kinds, arrow, parts)


# --- listing rows --------------------------------------------------------------------

ROWS = ("array<struct<is_row:boolean,href:string,anchor:string,text:string,description:string,date:string>>")
_ROWS = pa.list_(pa.struct({"is_row": pa.bool_(), **dict.fromkeys(("href", "anchor", "text", "description", "date"), pa.string())}))


def listing_items(html: Column, rules: tuple[Selector, ...], description: tuple[Selector, ...], date: tuple[Selector, ...],
                  category_path: str | None, per_page: int, per_fallback: int) -> Column:
    """Elements of the first rule that has any, else (with a path) the anchors whose address holds it.

    `anchor` and `href` are those of the first anchor inside, else of the one around the row; NULL without one.
    """
    def items(page: Page) -> list[dict]:
        for rule in rules:
            found = [e for e in page.elements if rule.fits(e)][:per_page]
            if found:
                return [row(page, e) for e in found]
        links = [e for e in page.elements if category_path is not None and e.name == "a"
                 and category_path in (e.get("href") or "")]
        return [{"is_row": False, "href": decoded(e.get("href")), "anchor": _flat(page.text_of(e)), "text": "",
                 "description": None, "date": None} for e in links[:per_fallback]]

    def row(page: Page, e: Element) -> dict:
        below = list(page.inside(e))
        anchor = next((x for x in below if x.name == "a"), None)
        around = e
        while anchor is None and around is not None:
            anchor, around = (around if around.name == "a" else None), around.parent
        told = next((x for x in below if any(s.fits(x) for s in description)), e)
        when = next((x for x in below if any(s.fits(x) for s in date)), None)
        return {"is_row": True, "href": anchor and decoded(anchor.get("href") or ""),
                "anchor": anchor and _flat(page.text_of(anchor)), "text": _flat(page.text_of(e)),
                "description": _flat(page.text_of(told)), "date": when and (when.get("datetime") or page.text_of(when))}

    return _walked(html, ROWS, _ROWS, items)
