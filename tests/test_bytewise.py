"""Rules over bytes give what the same rules give as columns of regexes and lambdas, at a fraction of their cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import html as H
from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.elements import BodyText, page_parts
from jobsieve.functions.text import (
    ascii_lower, blank_to_null, contains_any, earliest, ellipsis, first_keyword, last_line_value, last_newline, let, squeezed, text_lines, trimmed,
)
from jobsieve.operators.extract import with_full_description

T = F.col("t")
SPACES = (" ", "  ", "\t", "\n", "\n\n", "\r\n", "\x0b", *map(chr, (0x85, 0xA0, 0x180E, 0x2028, 0x2007, 0x3000, 0xFEFF)))
MARKS = (":", ": ", "-", "•", "✅", "🎁", "1.", "12. ", ".", ",", "©", "© 2025", "é", *map(chr, (0x130, 0x17F, 0x212A)), "$1", "\\", "a", "Z", "7")
SECTIONS = (
    "Requirements:", "requirement:", "REQUIREMENTS: ", "Qualifications", "qualification: ", "Minimum requirements", "Must have", "Experience", "Education",
    "needed", "required", "What We Offer:", "Benefits:", "benefit:", "Housing", "Medical", "provided", "Company will provide", "Accommodation", "Contact",
    "For More Details", "Salary", "Back", "Next", "Email to a Friend", "Chat on WhatsApp", "Phone:", "Hiring", "Job Details", "a b c d e f g h i j k",
    "long words about night work and meals that fill a stretch of the text up to its length " * 2)
LINES = ("Company", "employer:", "ORGANIZATION: ", "Experience: ", "degree ", "Education", "City: ", "area:", "riyadh", "Abha", "Khobar", "khobar", "taİf",
         "Salary", "wage: ", "SR", "sar ", "1,500", "riyal", "full time", "full-Time", "part", "contract", "time", "hindİ", "outlooK", "excel", "x" * 45)

# --- the same rules as columns ---------------------------------------------------------


def _any(words):
    return "|".join(words)


def opening_pattern(o):
    words, endings = _any(o.words), _any(o.endings)
    if not endings:
        return f"(?i)({words})"
    start = r"(?im)^" if o.on_line else r"(?is)\A"
    return rf"{start}(?>.*?(?=(?:{words})))((?:{words}).*?(?:{endings}))"


def rule_section(text, rule):
    opening, stops, blank_line = rule

    def cut(head, after):
        def inner(low):
            end = earliest(low, [s.lower() for s in stops])
            if blank_line:
                # Not `regexp_instr`, which counts a character beyond 16 bits as two.
                end = F.least(end, F.nullif(F.length(F.regexp_extract(low, r"(?s)\A(.*?\n)\n[a-z]", 1)), F.lit(0)))
            return F.concat(head, F.substr(after, F.lit(1), end - 1))
        return let(ascii_lower(after), inner)

    return let(F.regexp_extract(text, opening_pattern(opening), 1), lambda head: F.when(head == "", head).otherwise(
        let(F.substr(text, F.instr(text, head) + F.length(head)), lambda after: cut(head, after))))


def sections(text, rules, heading, bullet, bounds):
    def clean(found):
        flat = F.regexp_replace(squeezed(found), rf"\A((?s:.*?))(?i)(?:{bullet}[\h\v]*)?{heading}[\h\v]*", "$1")
        flat = F.regexp_replace(flat, bullet + r"[\h\v]*", "• ")
        flat = F.regexp_replace(flat, r"(?:^|\n)[\h\v]*[-•*][\h\v]*", "\n• ")
        return trimmed(F.regexp_replace(flat, r"(?:^|\n)[\h\v]*\d+\.[\h\v]*", "\n• "))

    return F.coalesce(*[let(clean(rule_section(text, r)), lambda x: F.when(F.length(x).between(*bounds), x)) for r in rules], F.lit(""))


def capped(text, rule, n=300, flat=False):
    found = F.regexp_extract(text, rf"(?i)(?:{_any(rule[0].words)})[\s\S]*?(?={_any(rule[1])}|\z)", 0)
    return F.substring(squeezed(found), 1, n) if flat else trimmed(F.substring(found, 1, n))


def longest(current, text):
    found = F.array(*[rule_section(text, r) for r in P.DESCRIPTION_RULES], F.regexp_extract(text, P.LONG_STRETCH, 0))
    return F.reduce(found, current, lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def between_marks(text):
    marks = F.array(*[F.struct((F.instr(text, m) - 1).alias("at"), F.lit(len(m)).alias("size")) for m in P.HEADER_END_MARKERS])
    start = F.reduce(marks, F.lit(0), lambda pos, m: F.when(m["at"] > pos, m["at"] + m["size"]).otherwise(pos))
    inner = let(F.substr(text, start + 1), lambda x: F.substr(x, F.lit(1), earliest(x, P.FOOTER_START_MARKERS) - 1))
    return let(inner, lambda x: F.when(F.length(x) > 100, trimmed(x)))


def described(df, p):
    d = F.col("want")
    out = df.withColumn("want", X.description(T, p.marker, p.marker_skip, p.end_markers))
    out = out.withColumn("want", F.when(F.length(d) < 100, longest(d, T)).otherwise(d))
    out = out.withColumn("want", F.when(F.length(d) < 50, F.coalesce(between_marks(T), d)).otherwise(d))
    out = out.withColumn("want", X.format_description(d, "long"))
    soft = let(last_newline(d, 1500), lambda cut: F.when(cut > 1000, F.concat(F.substr(d, F.lit(1), cut), F.lit(P.CONTINUED))).otherwise(ellipsis(d, 1500)))
    return out.withColumn("want", F.when(F.length(d) > 1500, soft).otherwise(d))


def labelled_value(line, rule):
    words, pattern, below = rule
    value = trimmed(F.regexp_extract(line, pattern, 1))
    due = contains_any(F.lower(line), words) & F.contains(line, F.lit(":")) & F.regexp_like(line, F.lit(pattern))
    return F.when(due & (F.length(value) < below), value)


def labelled(text, rule):
    return last_line_value(text_lines(text), lambda line: labelled_value(line, rule))


def location(text, cities):
    return last_line_value(text_lines(text), lambda line: F.coalesce(F.initcap(first_keyword(F.lower(line), cities)), labelled_value(line, P.LOCATION_LINE)))


def label(text, name):
    return blank_to_null(F.regexp_extract(F.lower(text), rf"{name}[\h\v:]+([^.\n]+)", 1))


# --- comparisons ------------------------------------------------------------------------

def odd_texts(spark, pieces, n=2500, size=14):
    pick = random.Random(11)
    kinds = (pieces, pieces, SPACES, MARKS)
    texts = [None, "", " ", "\n", "\n\n\n", *("".join(pick.choice(pick.choice(kinds)) for _ in range(pick.randint(1, size))) for _ in range(n))]
    return spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)


def check(df, pairs):
    columns = [c.alias(f"{kind}{i}") for i, pair in enumerate(pairs) for kind, c in zip(("want", "got"), pair)]
    wrong, told = [], set()
    for r in df.select("t", *columns).collect():
        for i in range(len(pairs)):
            told.add((i, r[f"want{i}"] not in (None, "", [])))
            if r[f"want{i}"] != r[f"got{i}"]:
                wrong.append((i, r.t, r[f"want{i}"], r[f"got{i}"]))
    assert wrong == [], wrong[:3]
    assert {i for i, found in told if found} == set(range(len(pairs)))


def test_sections(spark):
    rules = [*P.REQUIREMENTS_RULES, *P.BENEFITS_RULES, *P.DESCRIPTION_RULES]
    check(odd_texts(spark, SECTIONS), [
        *((rule_section(T, r), X.rule_section(T, r)) for r in rules),
        (sections(T, P.REQUIREMENTS_RULES, "Requirements:", "✅", (31, 599)), X.requirements(T)),
        (sections(T, P.BENEFITS_RULES, "What We Offer:", "🎁", (21, 499)), X.benefits(T)),
        *((capped(T, r, n, flat), X.capped_section(T, r, n, flat)) for r in (P.CAPPED_REQUIREMENTS, P.CAPPED_BENEFITS, P.SQUEEZED_REQUIREMENTS)
          for n, flat in ((300, False), (25, True)))])


def test_descriptions(spark):
    long = [("Chat on WhatsApp " + "é" * i + ("words " * 230 + "\n") * (i % 3) + "🎁 words" * 10 * i,) for i in range(60)]
    df = odd_texts(spark, SECTIONS, size=24).union(spark.createDataFrame(long, "t string"))
    check(df, [(longest(F.lit("seven"), T), X.longest_description(F.lit("seven"), T)), (between_marks(T), X.between_header_and_footer(T))])
    for skip in (16, 20, 3):
        p = P.full_profile("listings.example.com", marker_skip=skip)
        rows = with_full_description(described(df, p), p, "t").collect()
        assert [r for r in rows if r.want != r.description] == [] and sum(r.want != "" for r in rows) > 500
        assert skip != 16 or sum(r.want.endswith(P.CONTINUED) or r.want.endswith("...") for r in rows) > 5


def test_lines(spark):
    df = odd_texts(spark, LINES)
    others = (*P.CITIES, "é", "new dorp")
    check(df, [
        *((labelled(T, r), X.labelled_in(T, r)) for r in (P.COMPANY_LINE, P.EXPERIENCE_LINE, P.EDUCATION_LINE, P.LOCATION_LINE)),
        (location(T, P.CITIES), X.location_in(T)), (location(T, others), X.location_in(T, others)),
        (X.salary_phrase(text_lines(T), "line"), X.salary_phrase(T, "lines"))])


def test_labels_and_words(spark):
    from jobsieve.functions.bytewise import column, first_word, words_found

    check(odd_texts(spark, LINES), [
        *((label(T, k), X.labelled_lower(T, k)) for k in ("salary", "experience", "company", "education")),
        (F.regexp_extract(F.lower(T), P.EMPLOYMENT_LOOSE, 1), tags.employment_type_loose(T)),
        (tags.tag_skills(T), words_found(T, P.SKILLS)), (tags.tag_skills(T, ("é", "excel")), words_found(T, ("é", "excel"))),
        (tags.employment_type(T, ("khobar", "contract", "hindi")), F.coalesce(column(first_word(("khobar", "contract", "hindi")), T), F.lit("")))])


def test_page_text_of_the_walk(spark):
    pick = random.Random(3)
    pieces = ("<p>", "</p>", "<BODY x>", "<body>", "</body>", "<bodyx>", "<script>", "</script>", "<stylex>", "<!--", "-->", "<", ">", "&amp;lt;", "&am", "p;", "a ", "é", "<br>", "< q>")
    pages = [None, *("".join(pick.choice(pieces[:6] + pieces[13:19] if i % 2 else pieces) for _ in range(pick.randint(0, 12))) for i in range(3000))]
    df = spark.createDataFrame([(p,) for p in pages], "html string").repartition(4)
    rows = df.select("html", H.body_text(F.col("html")).alias("want"), page_parts(F.col("html"), text=BodyText())["text"].alias("got")).collect()
    assert [r for r in rows if r.got is not None and r.got != r.want] == []
    assert sum(r.got is not None for r in rows) > 1500 and [r.got for r in rows if r.html is None] == [None]


LINE = "Long shifts, night work and weekends may apply; meals are served on site and buses run from the city\n"


@pytest.mark.parametrize("chain, rule, share", [
    (lambda: sections(T, P.REQUIREMENTS_RULES, "Requirements:", "✅", (31, 599)), lambda: X.requirements(T), 0.8),
    (lambda: longest(F.lit(""), T), lambda: X.longest_description(F.lit(""), T), 0.8),
    (lambda: location(T, P.CITIES), lambda: X.location_in(T), 0.8),
    (lambda: F.array_join(tags.tag_skills(T), ","), lambda: F.array_join(__import__("jobsieve.functions.bytewise", fromlist=["x"]).words_found(T, P.SKILLS), ","), 0.85),
    (lambda: F.regexp_extract(F.lower(T), P.EMPLOYMENT_LOOSE, 1), lambda: tags.employment_type_loose(T), 0.9)])
def test_cost(spark, chain, rule, share):
    df = spark.range(300, numPartitions=4).select(F.concat(F.lit("Job Details: driver\nCity: x\n"), F.repeat(F.lit(LINE), 300), F.lit("© 2025"), F.col("id").cast("string")).alias("t"))

    def seconds(c):
        best = 99
        for _ in range(3):
            start = time.perf_counter()
            df.select(F.sum(F.length(c))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    old, new = seconds(chain()), seconds(rule())
    assert new < share * old, (new, old)
