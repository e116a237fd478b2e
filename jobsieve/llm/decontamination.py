r"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become canonical tokens: numbers (in digits or words), units and capitalised names
turn into typed placeholders, other words lose case and punctuation. Neighbouring names without punctuation between
them fold into one placeholder, and so do neighbouring numbers and units, so that `Tom Reed` stands for `Ann` and `5kg` for `3 pounds`. Every window of WINDOW
tokens is hashed and joined to the windows of the benchmark; for items that may be told by fewer tokens, windows of so
many tokens too. Hits that agree on the shift between document and item form a candidate span. The span is verified on
the texts: tokens must agree over LEAST_RUN tokens or LEAST_SHARE of the item, LEAST_PLAIN of them plain words (all
plain words of an item that has three), and slots must be filled consistently (one value of the item always stands for
one value in the document). So a question is found again when its numbers, names and units are changed, and the result
tells exact copies from re-parameterised ones.

Placeholders alone tell nothing: items of fewer than MIN_PLAIN plain words (`3 + 4 = ?`) are looked for literally, by all
their words in a row, and reported as `literal`. Windows of fewer than two plain words start no candidate.

NULL and empty texts have no tokens; texts may have any length; repeated rows give their results once per row; empty
tables give an empty result; other columns are ignored or, by `clean_documents`, kept as they are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.llm.common import BROADCAST_ROWS, saved, small_side

WINDOW = 8
LEAST_RUN = 13          # tokens in agreement; the whole item where it is shorter
LEAST_SHARE = 0.6       # or this share of the item's tokens
LEAST_PLAIN = 4         # plain words among them
MIN_PLAIN = 3           # plain words of an item that is looked for by its template
KNOWN = 200_000         # words a task remembers from one slice of texts to the next
SLICE = 1_000_000       # characters of texts that are hashed at once
FILTER_BITS = 16        # places of the filter for each window of the benchmark

# Units of measure and currency that stand in questions.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l cl s sec secs second seconds min mins minute minutes h hr hrs hour hours day "
    "days week weeks month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot "
    "feet yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons "
    "dollar dollars euro euros cent cents percent usd eur gbp kmh mph".split())
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
# Words that are no names although sentences and questions start with them.
OPENINGS = frozenset(
    "a about after all also although an and any are as at be because before both but by calculate can choose compute "
    "consider could define describe determine did do does during each either estimate evaluate every explain find first "
    "for from give given had has have he her here his how however i if in into is it its last let list many more most "
    "much my name next no not now of off on once only or our out over select she should show since so solve some state "
    "suppose take than that the their then there these they this those through to today under until up use using was we "
    "were what when where whether which while who whom whose why will with write yesterday you your".split())
NUMBER, NAME, UNIT = "\x01number", "\x01name", "\x01unit"
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_MEASURE = re.compile(r"[+-]?\d[\d.,:/]*([a-z]+)")
_EDGE = re.compile(r"^\W+|\W+$")
_STOPS = tuple(".,;:!?")
# Tokens of one group fold where they stand side by side.
GROUPS = {NAME: 1, NUMBER: 2, UNIT: 2}


def bare(word: str) -> str:
    """The word without punctuation at its ends, in lower case."""
    return _EDGE.sub("", word).lower()


def canonical(word: str) -> tuple[str, str]:
    """Token and slot value ('' for plain words); no token for a word without a letter or digit."""
    cut = _EDGE.sub("", word)
    low = cut.lower()
    measure = _MEASURE.fullmatch(low)
    if _NUMBER.fullmatch(cut) or low in NUMBER_WORDS or measure and measure[1] in UNITS:
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    if cut[:1].isupper() and not cut[1:2].isupper() and cut[1:].islower() and low not in OPENINGS:
        return NAME, low
    return low, ""


@dataclass
class Tokens:
    """Folded tokens with their slot values and the number of the word at which each starts; literal words."""
    kinds: list[str]
    values: list[str]
    starts: list[int]
    words: list[str]

    @property
    def plain(self) -> int:
        return sum(k not in GROUPS for k in self.kinds)

    @property
    def literal(self) -> bool:
        """To be looked for by its words: placeholders are most of what it has."""
        return self.plain < MIN_PLAIN


def tokens(text: str | None) -> Tokens:
    out, last = Tokens([], [], [], []), 0
    for i, word in enumerate((text or "").split()):
        out.words.append(bare(word) or word)
        kind, value = canonical(word)
        if not kind:
            continue
        group = GROUPS.get(kind, 0)
        if group and group == last:
            out.values[-1] += value
        else:
            out.kinds.append(kind)
            out.values.append(value)
            out.starts.append(i)
        last = 0 if word.endswith(_STOPS) else group
    return out


class _Words(dict):
    """Number of every word seen; by number: hash of its token (0: none), its group, the group that it leaves open, hash of
    the literal word."""

    def __init__(self) -> None:
        super().__init__()
        self.kind, self.group, self.open, self.literal = array("Q"), array("B"), array("B"), array("Q")

    def __missing__(self, word: str) -> int:
        kind = canonical(word)[0]
        self.kind.append(xxhash.xxh3_64_intdigest(kind) if kind else 0)
        self.group.append(GROUPS.get(kind, 0))
        self.open.append(0 if word.endswith(_STOPS) else GROUPS.get(kind, 0))
        self.literal.append(xxhash.xxh3_64_intdigest(bare(word) or word))
        self[word] = number = len(self)
        return number


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` tokens."""
    n = max(len(h) - size + 1, 0)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j:j + n]
        out ^= out >> np.uint64(29)
    return out


class _Hasher:
    """64-bit hashes of the folded tokens and of the literal words of texts; looks at every different word once."""

    def __init__(self) -> None:
        self.words = _Words()

    def read(self, texts: list[str | None]) -> tuple[tuple, tuple]:
        """Two streams (hashes of the texts, one after the other; number in each text; what counts as plain).

        The first is of folded tokens, the second of literal words, all of which count.
        """
        if len(self.words) >= KNOWN:
            self.words = _Words()
        number, numbers, stops = self.words.__getitem__, [], []
        for text in texts:
            numbers.extend(map(number, (text or "").split()))
            stops.append(len(numbers))
        at = np.array(numbers, np.int64)
        text_no = np.repeat(np.arange(len(texts)), np.diff(stops, prepend=0))
        table = [np.frombuffer(x, d) if len(x) else np.empty(0, d) for x, d in (
            (self.words.kind, np.uint64), (self.words.group, np.uint8), (self.words.open, np.uint8),
            (self.words.literal, np.uint64))]
        literal = table[3][at], np.bincount(text_no, minlength=len(texts)), np.ones(len(at), bool)
        h = table[0][at]
        some = h != 0
        h, group, left_open, text_no = h[some], table[1][at[some]], table[2][at[some]], text_no[some]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (group[1:] == 0) | (group[1:] != left_open[:-1]) | (text_no[1:] != text_no[:-1])
        folded = h[fresh], np.bincount(text_no[fresh], minlength=len(texts)), group[fresh] == 0
        return folded, literal


def least_run(size: int) -> int:
    """Tokens in a row that must agree for an item of `size` tokens."""
    return min(LEAST_RUN, size, math.ceil(LEAST_SHARE * size))


# By the size of the item; the last one holds for all larger items.
_LENGTHS = np.array([min(WINDOW, least_run(size)) for size in range(math.ceil(WINDOW / LEAST_SHARE) + 1)])


def _windows(stream: tuple, size: int, plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first token of every window of `size` tokens, `plain` of them plain, that lies in one text."""
    h, counts, good = stream
    text = np.repeat(np.arange(len(counts)), counts)
    n = max(len(h) - size + 1, 0)
    sums = np.concatenate([[0], np.cumsum(good)])
    first = np.flatnonzero((text[:n] == text[size - 1:]) & (sums[size:] - sums[:n] >= plain)) if n else np.empty(0, np.int64)
    text = text[first]
    return _rolled(h, size)[first], text, first - (np.cumsum(counts) - counts)[text]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Borders of slices of up to SLICE characters or one text."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > SLICE and i > lo:
            yield lo, i
            lo, size = i, len(text or "")
    yield lo, len(texts)


def item_windows(items: DataFrame) -> DataFrame:
    """item, window (hash), place, length and literal for the windows of the items; the item's size gives the length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            folded, words = hasher.read(batch.column(1).to_pylist())
            text = np.repeat(np.arange(batch.num_rows), folded[1])
            literal = np.bincount(text[folded[2]], minlength=batch.num_rows) < MIN_PLAIN
            for stream, mine in ((folded, ~literal), (words, literal)):
                if stream is folded:
                    lengths = _LENGTHS[np.minimum(stream[1], len(_LENGTHS) - 1)]
                else:
                    lengths = np.minimum(stream[1], WINDOW)
                lengths = np.where(mine, lengths, 0)
                for size in np.unique(lengths[lengths > 0]).tolist():
                    found, text, at = _windows(stream, size, _plain_in(size, stream is words))
                    own = lengths[text] == size
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text[own])), pa.array(found[own].view(np.int64)),
                         pa.array(at[own].astype(np.int32)), pa.array(np.full(own.sum(), size, np.int32)),
                         pa.array(np.full(own.sum(), stream is words))], ["item", "window", "place", "length", "literal"])

    return items.select("item", "text").mapInArrow(
        run, "item long, window long, place int, length int, literal boolean")


def _plain_in(size: int, literal: bool) -> int:
    """Plain tokens that a window needs."""
    return size if literal else min(2, size)


def _places(windows: DataFrame) -> np.ndarray | None:
    """Filter of the hashes that the benchmark has, by their last bits; None where it would grow too large."""
    if windows.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    found = windows.select("window").toArrow().column(0).to_numpy().view(np.uint64)
    out = np.zeros(1 << (FILTER_BITS * max(len(found), 1)).bit_length(), bool)
    out[found & np.uint64(len(out) - 1)] = True
    return out


def window_rows(df: DataFrame, keys: list[str], sizes: list[tuple[int, bool]], places: np.ndarray | None = None) -> DataFrame:
    """`keys` (longs), `literal`, `window` (hash) and `at` for the windows of all `sizes` (tokens, literal) of `text`.

    Windows that the filter `places` rules out are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            for lo, hi in _slices(texts):
                streams = hasher.read(texts[lo:hi])
                for size, literal in sizes:
                    found, text, at = _windows(streams[literal], size, _plain_in(size, literal))
                    if places is not None:
                        known = places[found & np.uint64(len(places) - 1)]
                        found, text, at = found[known], text[known], at[known]
                    row = pa.array(text + lo)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(row) for k in range(len(keys))], pa.array(np.full(len(found), literal)),
                         pa.array(found.view(np.int64)), pa.array(at.astype(np.int32))], [*keys, "literal", "window", "at"])

    return df.select(*keys, "text").mapInArrow(
        run, ", ".join(f"{k} long" for k in keys) + ", literal boolean, window long, at int")


def agreement(doc: Tokens, item: Tokens, shift: int) -> tuple[int, int, int, int] | None:
    """Best sufficient run of consistent tokens at one shift: (first token, tokens, changed slots, slots).

    A run breaks where tokens differ or where a slot value of the item already stands for another value.
    """
    need, least = min(LEAST_PLAIN, item.plain), least_run(len(item.kinds))
    best, run, first, changed, slots, table = None, 0, 0, 0, 0, {}
    for j in range(max(0, -shift), min(len(item.kinds), len(doc.kinds) - shift)):
        i = j + shift
        own, other = doc.values[i], item.values[j]
        slot = bool(other)
        if doc.kinds[i] != item.kinds[j] or slot and table.setdefault((item.kinds[j], other), own) != own:
            run, changed, slots, table = 0, 0, 0, {}
            if doc.kinds[i] != item.kinds[j]:
                continue
            if slot:
                table[item.kinds[j], other] = own
        if not run:
            first = i
        run += 1
        slots += slot
        changed += slot and own != other
        if run >= least and run - slots >= need:
            best = max(best or (0,), (run, -first, changed, slots))
    return best and (-best[1], best[0], best[2], best[3])


def evidence(doc: Tokens, item: Tokens, shifts: list[int]) -> tuple[int, int, int, int] | None:
    """Best of the shifts: (first word, tokens, changed slots, slots); None where none suffices."""
    if item.literal:
        n = len(item.words)
        found = [s for s in shifts if n and s >= 0 and doc.words[s:s + n] == item.words]
        return (min(found), n, 0, 0) if found else None
    found = [x for x in (agreement(doc, item, s) for s in shifts) if x]
    if not found:
        return None
    first, *rest = max(found, key=lambda x: (x[1], -x[0]))
    return doc.starts[first], *rest


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold benchmark items: _row, _sum (hashes of id and text), doc_id, item_id, first_word, n_tokens,
    n_slots, n_changed, literal, exact (no slot changed). One row per document, item and text; NULL item ids are
    compared too.
    """
    items = (benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
             .withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item", "text"]))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("_row"), F.crc32(text).alias("_sum"),
                       F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    of_items = saved(item_windows(items), "items")
    # WINDOW lengths of either kind at most.
    sizes = sorted((r["length"], r["literal"]) for r in of_items.select("length", "literal").distinct().collect())
    hits = window_rows(rows, ["_row", "_sum"], sizes, _places(of_items)).join(
        small_side(of_items.drop("length")), ["literal", "window"])
    shifts = hits.select("_row", "_sum", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    per_text = shifts.groupBy("_row", "_sum", "item").agg(F.collect_list("shift").alias("shifts"))
    per_text = per_text.join(small_side(saved(items, "texts")).select("item", "item_id", F.col("text").alias("item_text")), "item")
    suspects = saved(per_text.groupBy("_row", "_sum").agg(F.collect_list(F.struct("item_id", "item_text", "shifts")).alias("found")),
                     "suspects")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (t, found) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                doc = tokens(t)
                for f in found:
                    item = tokens(f["item_text"])
                    if best := evidence(doc, item, f["shifts"]):
                        first, n, changed, slots = best
                        out.append((i, f["item_id"], first, n, slots, changed, item.literal))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in range(3)],
                 *[pa.array([o[k] for o in out], pa.int64()) for k in range(1, 6)],
                 pa.array([o[6] for o in out], pa.bool_())],
                ["_row", "_sum", "doc_id", "item_id", "first_word", "n_tokens", "n_slots", "n_changed", "literal"])

    # Slim keys pick the texts; these few meet their items by a shuffle.
    keys = saved(suspects.select("_row", "_sum"), "keys")
    picked = rows.join(small_side(keys), ["_row", "_sum"], "left_semi")
    found = picked.join(suspects, ["_row", "_sum"]).select("_row", "_sum", "doc_id", "text", "found").mapInArrow(
        run, "_row long, _sum long, doc_id long, item_id long, first_word long, n_tokens long, n_slots long, n_changed long, "
             "literal boolean")
    return found.withColumn("exact", F.col("n_changed") == 0)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated documents only: doc_id, item_id, first_word, n_tokens, n_slots, n_changed, literal, exact."""
    return contaminated(docs, benchmark).drop("_row", "_sum")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, with their own columns."""
    text = F.coalesce("text", F.lit(""))
    bad = small_side(saved(contaminated(docs, benchmark).select("_row", "_sum").distinct(), "leaks"))
    hit = (F.xxhash64("doc_id", text) == bad["_row"]) & (F.crc32(text) == bad["_sum"])
    return docs.join(bad, hit, "left_anti")
