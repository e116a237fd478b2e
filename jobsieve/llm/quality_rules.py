r"""Quality rules: repetition counts and divergence from language references.

A document is rejected when it is short or repetitive (base rule), or when its histogram of character classes or
of common words is far, by Jensen-Shannon distance (base 2, 0 to 1), from the reference of its language. References
are the mean histograms over all documents of a language. Short texts have no stable histogram, so each test has a
guard: a least number of characters and of words.

NULL texts count as empty (base rule fails). Documents whose language is NULL or not in LANGUAGES are compared with
the mean over all documents, by character classes only. Texts may have any length, repeated rows give their result once
per row, an empty table an empty result; other columns are ignored or, by `kept_documents`, kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions.text import let
from jobsieve.llm.common import fresh, once

# Common function words of each language.
LANGUAGES = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht", "ist", "des", "im", "für", "ein", "eine"),
    "en": ("the", "of", "and", "to", "in", "is", "was", "for", "that", "with", "on", "at", "by", "are", "this", "from"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par"),
}
CLASSES = ("letters", "upper", "digits", "spaces", "symbols", "marks")

MIN_WORDS = 10          # base rule
MAX_REPEAT = 20         # base rule, percent of words in repeated windows
WINDOW = 5              # words in a window of the base rule
GUARD_CHARS = 200       # fewer characters than this: no test of character classes
GUARD_WORDS = 100       # fewer words than this: no test of common words
MAX_CLASS_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.29

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def _size_without(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def with_windows(df: DataFrame, keep: list, words: str) -> DataFrame:
    """`keep` and `_windows`: a 64-bit hash of every five words in a row, empty for fewer words.

    Built by doubling: words, pairs, fours, fives.
    """
    def joined(x: str, y: str, by: int) -> Column:
        return F.zip_with(x, F.slice(y, F.lit(by + 1), F.size(y)), lambda a, b: F.xxhash64(a, b))

    df = once(df, [*keep, words], _h1=F.transform(words, lambda x: F.xxhash64(x)))
    df = once(df, [*keep, words, "_h1"], _h2=joined("_h1", "_h1", 1))
    df = once(df, [*keep, words, "_h1"], _h4=joined("_h2", "_h2", 2))
    fives = F.slice(joined("_h4", "_h1", 4), F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))
    return once(df, [*keep, words], _windows=fives)


def repeat_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words that stand in a window of words found twice or more in the text, the first one included.

    Sorted by hash and place, equal windows are neighbours; their places give the covered words. Texts without
    a repeated window skip the sort.
    """
    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(
            s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes)).cast("bigint")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def _shares(counts: Column) -> Column:
    """The counts divided by their sum; all 0 where the sum is 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(F.lit(0.0))))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def _common_words(words: Column, lang: Column) -> Column:
    """The words that are common in the language, lower-case ones only; none for other languages."""
    found = None
    for code, common in LANGUAGES.items():
        hits = F.filter(words, lambda x: x.isin(*common))
        found = F.when(lang == code, hits) if found is None else found.when(lang == code, hits)
    return F.coalesce(found, F.array().cast("array<string>"))


def _histograms(docs: DataFrame, keep: list, text: Column, lang: Column) -> DataFrame:
    """`keep` with _text, _words, the counts of the base rule, and the shares _classes and _common.

    _common holds the language's common words (lower-case ones), then all others together.
    """
    text = F.coalesce(text, F.lit(""))
    bins = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    df = once(docs, keep, _text=text, _rest=F.regexp_replace(text, r"\p{L}+", ""), _words=split_words(text),
              _lang=F.coalesce(lang, F.lit("")), _bins=F.coalesce(F.try_element_at(bins, lang), none))
    kept = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in keep]
    df = once(df, [*kept, "_text", "_rest", "_words", "_lang", "_bins"],
              _found=_common_words(F.col("_words"), F.col("_lang")))
    chars, rest = F.length("_text"), F.length("_rest")
    upper = F.regexp_count("_text", F.lit(r"\p{Lu}"))
    sizes = {"digits": r"\p{N}+", "spaces": SPACE, "symbols": SYMBOLS}
    counts = {k: rest - _size_without(F.col("_rest"), p) for k, p in sizes.items()}
    counts |= {"letters": chars - rest - upper, "upper": upper}
    common = F.transform("_bins", lambda x: (F.size("_found") - F.size(F.array_remove("_found", x))).cast("double"))
    df = once(df, [*kept, "_text", "_words", "_lang"],
              _n_chars=chars.cast("bigint"), _n_words=F.size("_words").cast("bigint"),
              _word_chars=(chars - counts["spaces"]).cast("bigint"), _n_symbols=counts["symbols"].cast("bigint"),
              _classes=F.array(*[counts[c].cast("double") for c in CLASSES[:-1]]), _common=common)
    seen = F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x)
    others = F.aggregate("_common", F.lit(0.0), lambda a, x: a + x)
    return once(df, [*kept, "_text", "_words", "_lang", "_n_chars", "_n_words", "_word_chars", "_n_symbols"],
                _classes=_shares(F.array_append("_classes", F.col("_n_chars") - seen)),
                _common=_shares(F.array_append("_common", F.col("_n_words") - others)))


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """Mean histograms by language ('' for all documents together), over all documents that pass the guards.

    One row for each named language reaches the driver. Rounded to six digits, so that the order in which
    partial sums meet does not matter.
    """
    known = F.when(F.col("_lang").isin(*LANGUAGES), F.col("_lang")).otherwise(F.lit(""))
    rows = _histograms(docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")), [], F.col("t"), F.col("l"))
    rows = rows.select(known.alias("lang"), "_n_chars", "_n_words", "_classes", "_common")

    def means(column: str, n: int, guard: Column) -> list[Column]:
        return [F.avg(F.when(guard, F.get(column, F.lit(i)))).alias(f"{column}{i}") for i in range(n)]

    widest = max(map(len, LANGUAGES.values())) + 1
    found = rows.groupBy("lang").agg(
        F.count(F.when(F.col("_n_chars") >= GUARD_CHARS, 1)).alias("n"),
        *means("_classes", len(CLASSES), F.col("_n_chars") >= GUARD_CHARS),
        *means("_common", widest, F.col("_n_words") >= GUARD_WORDS)).collect()
    out, total = {}, [0.0] * len(CLASSES)
    for r in found:
        classes = [round(r[f"_classes{i}"] or 0.0, 6) for i in range(len(CLASSES))]
        total = [t + x * r["n"] for t, x in zip(total, classes)]
        if r["lang"]:
            n = len(LANGUAGES[r["lang"]]) + 1
            out[r["lang"]] = {"classes": classes, "common": [round(r[f"_common{i}"] or 0.0, 6) for i in range(n)]}
    n = sum(r["n"] for r in found)
    out[""] = {"classes": [round(t / n, 6) if n else 0.0 for t in total], "common": []}
    return out


def _lookup(refs: dict, part: str) -> Column:
    table = F.create_map(*[x for k, v in refs.items() for x in (
        F.lit(k), F.array(*map(F.lit, v[part])).cast("array<double>"))])
    return F.coalesce(F.try_element_at(table, F.col("_lang")), F.try_element_at(table, F.lit("")))


def judged(docs: DataFrame, refs: dict, keep: list, text: str = "text", lang: str = "lang", full: bool = True) -> DataFrame:
    """`keep` and the counts, distances, base_failed and kept of every row.

    Without `full` the columns that no verdict needs (n_dup_lines) are left out.
    """
    df = _histograms(docs, keep, F.col(f"`{text}`"), F.col(f"`{lang}`"))
    kept = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in keep]
    more = {"n_dup_lines": dup_lines(F.col("_text"))} if full else {}
    kept += ["_n_chars", "_n_words", "_word_chars", "_n_symbols"]
    df = with_windows(df, [*kept, "_text", "_lang", "_classes", "_common"], "_words")
    df = once(df, kept, **more,
              n_repeat_words=repeat_words(F.col("_windows")),
              class_distance=_distance(F.col("_classes"), _lookup(refs, "classes")),
              word_distance=_distance(F.col("_common"), _lookup(refs, "common")))
    failed = (F.col("_n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("_n_words") * MAX_REPEAT)
    far = (((F.col("_n_chars") >= GUARD_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE))
           | ((F.col("_n_words") >= GUARD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)))
    return df.select(*kept[:len(keep)], F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"),
                     F.col("_n_symbols").alias("n_symbols"), *more, "n_repeat_words", failed.alias("base_failed"),
                     (~failed & ~far).alias("kept"), F.round("class_distance", 4).alias("class_distance"),
                     F.round("word_distance", 4).alias("word_distance"))


def document_rules(docs: DataFrame) -> DataFrame:
    """The rules over documents: doc_id and all counts and verdicts."""
    slim = docs.select("doc_id", "text", "lang")
    return judged(slim, references(slim), ["doc_id"])


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
                         F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    refs = references(docs, text, lang)
    return judged(packed, refs, [row], "t", "l", full=False).where("kept").select(f"{row}.*")
