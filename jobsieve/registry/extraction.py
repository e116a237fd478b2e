"""Queries that turn posting texts and documents into fields."""

from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.elements import page_parts
from jobsieve.functions.text import text_lines
from jobsieve.operators.extract import computed_once, drop_challenge, extract_postings, with_full_description
from jobsieve.registry.base import OWN_DOMAIN, STAMP, fx_posting_text, fx_rich_text, query, table
from jobsieve.registry.links import CUT, trim_sql
from jobsieve.schema import POSTING_COLUMNS
from jobsieve.session import spread

T = ("fx_posting_text",)
R = ("fx_rich_text",)
CHALLENGE = "(contains(lower(body_text), 'verify you are human') OR contains(lower(body_text), 'checking your browser'))"


def cascade(col, patterns, group=1):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '{p}', {group}), '')" for p in patterns) + ", '')"


# The patterns of profile.py in the dialect of the SQL engine.
SALARY = ("(?i)Salary:?\\s*(\\d{3,5})", "(?i)salary\\s+(\\d{3,5})", "(?i)(\\d{4})\\s*(?:SR|SAR|Riyal)", "(?i)(\\d{3,5})\\s*SAR")
LOCATION = ("(?i)Region:\\s*([^\\n\\r()]+)", "(?i)Location:\\s*\\[([^\\]]+)\\]", "(?i)Location:\\s*([^\\n\\r]+)", "(?i)City:\\s*([^\\n\\r]+)")
IDS = ("(?i)Posting ID:\\s*(\\d+)", "(?i)Post ID:\\s*(\\d+)", "(?i)ID:\\s*(\\d+)")
POSTED = ("(?i)Posted:\\s*([^\\n\\r]+)", "(?i)Date:\\s*([^\\n\\r]+)", "(\\d{1,2}/\\d{1,2}/\\d{4})", "(\\d{1,2}-\\d{1,2}-\\d{4})",
          "(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{1,2},?\\s+\\d{4})")
EMAILS = ("(?i)From:\\s*([^\\s@]+@[^\\s]+\\.[^\\s]+)", "([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,})", "(?i)Email:\\s*([^\\s@]+@[^\\s]+)")
PHONES = ("\\b05\\d{8}\\b", "\\b01\\d{8}\\b", "\\+966\\d{9}", "\\b\\d{10}\\b")


def email_sql(col):
    return "coalesce(" + ", ".join(
        f"CASE WHEN regexp_extract({col}, '{p}', 1) <> '' AND NOT contains(regexp_extract({col}, '{p}', 1), '{OWN_DOMAIN}') "
        f"THEN regexp_extract({col}, '{p}', 1) END" for p in EMAILS) + ", '')"


def once_joined(lst):
    return f"array_to_string(list_filter({lst}, lambda x, i: list_position({lst}, x) = i), ', ')"


def all_sql(col, patterns):
    return "list_concat(" + ", ".join(f"regexp_extract_all({col}, '{p}')" for p in patterns) + ")"


@query("extract_core", f"""
SELECT seq, {cascade('body_text', SALARY)} AS salary, {trim_sql(cascade('body_text', LOCATION))} AS location,
  coalesce(nullif({cascade('body_text', IDS)}, ''), regexp_extract(url, 'cls/(\\d+)\\.html', 1)) AS posting_id
FROM fx_posting_text WHERE NOT {CHALLENGE}""", T)
def extract_core(spark, sf):
    text, url = F.col("body_text"), F.col("url")
    return drop_challenge(fx_posting_text(spark, sf)).select(
        "seq", X.salary(text).alias("salary"), X.location(text).alias("location"), X.posting_id(text, url).alias("posting_id"))


@query("extract_email", f"SELECT seq, {email_sql('body_text')} AS email FROM fx_posting_text", T)
def extract_email(spark, sf):
    return fx_posting_text(spark, sf).select("seq", X.email(F.col("body_text"), OWN_DOMAIN).alias("email"))


@query("extract_contacts", f"""
WITH c AS (SELECT seq, {all_sql('body_text', PHONES)} AS l FROM fx_posting_text) SELECT seq, {once_joined('l')} AS contact FROM c""", T)
def extract_contacts(spark, sf):
    return fx_posting_text(spark, sf).select("seq", X.contacts(F.col("body_text")).alias("contact"))


LOOSE = ("\\+966[\\d\\s-]{9,}", "05[\\d\\s-]{8,}", "01[\\d\\s-]{8,}", "0\\d{9}")


@query("contact_loose", f"""
WITH c AS (SELECT seq, body_text, list_transform({all_sql('body_text', LOOSE)}, lambda x: {trim_sql('x')}) AS l FROM fx_rich_text)
SELECT seq, nullif(regexp_extract(body_text, '(?:\\+966|05|01)[\\d\\s-]{{8,}}', 0), '') AS first_phone, {once_joined('l')} AS phones,
  list_filter(list_transform(string_split(body_text, chr(10)), lambda s: CASE WHEN regexp_matches(lower({trim_sql('s')}), 'contact|phone|mobile|email')
    THEN coalesce(nullif(regexp_extract({trim_sql('s')}, '(?:\\+966|05|01)[\\d\\s-]{{8,}}', 0), ''),
      nullif(regexp_extract({trim_sql('s')}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', 0), '')) END), lambda v: v IS NOT NULL)[-1] AS line_contact
FROM c""", R)
def contact_loose(spark, sf):
    text = F.col("body_text")
    return fx_rich_text(spark, sf).select(
        "seq", X.contact_loose(text).alias("first_phone"), X.contacts_loose(text).alias("phones"),
        X.contact_of_lines(text_lines(text)).alias("line_contact"))


LINES = f"list_filter(list_transform(string_split(body_text, chr(10)), lambda s: {trim_sql('s')}), lambda s: s <> '')"


def last_sql(value):
    """Last non-NULL value over the lines; `value` is SQL over `s`."""
    return f"list_filter(list_transform({LINES}, lambda s: {value}), lambda v: v IS NOT NULL)[-1]"


FREE = ("(?i)Salary:?\\s*(\\d+[^\\n\\r]*)", "(?i)salary\\s*(\\d+[^\\n\\r]*)", "(?i)(\\d+)\\s*(?:sr|sar|riyal)", "(?i)fixed salary[^\\n\\r]*?(\\d+)")
LINE_SALARY = ("coalesce(nullif(regexp_extract(s, '(?i)(?:salary|wage)[\\s:]*(.+)', 1), ''), nullif(regexp_extract(s, '(?i)(sr|sar)[\\s]*([\\d,]+)', 1), ''), "
               "nullif(regexp_extract(s, '(?i)(\\d+[\\s,]*(?:sr|sar|riyal))', 1), ''))")


@query("salary_phrase", f"""
SELECT seq, nullif(trim(regexp_extract(body_text, '(?i)(\\d+[\\s,]*(?:sr|sar|riyal|monthly|yearly))', 1)), '') AS listing_salary,
  nullif({cascade('body_text', FREE)}, '') AS free_salary,
  {last_sql(f"CASE WHEN regexp_matches(lower(s), 'salary|wage|sr|sar') AND (contains(s, ':') OR regexp_matches(s, '[0-9]')) THEN {trim_sql(LINE_SALARY)} END")} AS line_salary
FROM fx_rich_text""", R)
def salary_phrase(spark, sf):
    text = F.col("body_text")
    return fx_rich_text(spark, sf).select(
        "seq", X.salary_phrase(text, "listing").alias("listing_salary"), X.salary_phrase(text, "free").alias("free_salary"),
        X.salary_phrase(text_lines(text), "line").alias("line_salary"))


@query("extract_posted", f"""
WITH p AS (SELECT seq, url, {trim_sql(cascade('body_text', POSTED))} AS posted_date, {trim_sql("regexp_extract(body_text, '(?i)Category:\\s*([^\\n\\r]+)', 1)")} AS category FROM fx_posting_text)
SELECT seq, posted_date, category, CAST(try_strptime(regexp_replace(posted_date, '^[A-Za-z]+day, ', ''), '%b %d, %Y, %I:%M:%S %p') AS VARCHAR) AS posted_at,
  nullif(regexp_extract(url, '/cls/(\\d+)', 1), '') AS job_id, regexp_replace(string_split(url, '/')[-1], '\\.html', '') AS url_tail FROM p""", T)
def extract_posted(spark, sf):
    text = F.col("body_text")
    out = fx_posting_text(spark, sf).select("seq", "url", X.posted_date(text).alias("posted_date"), X.category(text).alias("category"))
    return out.select("seq", "posted_date", "category", X.posted_at(F.col("posted_date")).cast("string").alias("posted_at"),
                      X.job_id(F.col("url")).alias("job_id"), X.url_tail(F.col("url")).alias("url_tail"))


ENDS, MORE_ENDS = P.END_MARKERS, P.MORE_END_MARKERS


def until_sql(col, markers):
    ends = ", ".join(f"coalesce(nullif(instr({col}, '{m}'), 0), length({col}) + 1)" for m in markers)
    return f"substring({col}, 1, least({ends}) - 1)"


def after_sql(col, skip):
    return f"substring({col}, instr({col}, 'Chat on WhatsApp') + {skip})"


def description_sql(col, skip, markers=ENDS):
    return f"CASE WHEN contains({col}, 'Chat on WhatsApp') THEN {trim_sql(until_sql(after_sql(col, skip), markers))} ELSE '' END"


@query("extract_description", f"""
SELECT seq, {description_sql('body_text', 16)} AS description, {description_sql('body_text', 20)} AS description_skip20 FROM fx_posting_text""", T)
def extract_description(spark, sf):
    text = F.col("body_text")
    return fx_posting_text(spark, sf).select("seq", X.description(text).alias("description"),
                                             X.description(text, marker_skip=20).alias("description_skip20"))


def re_all(col, pairs):
    for p, r in pairs:
        col = f"regexp_replace({col}, '{p}', {r}, 'g')"
    return col


# Replacements that lay out a description, in the dialect of the SQL engine.
CALM = (("[ \\t]+", "' '"), ("\\n\\s*\\n\\s*\\n", "repeat(chr(10), 2)"), ("^\\s+|\\s+$", "''"))
SHORT_HEADS = (("(?i)Job Details:\\s*", "concat(chr(10), '📋 Job Details:', chr(10))"), ("(?i)Requirements:\\s*", "concat(chr(10), '✅ Requirements:', chr(10))"),
               ("(?i)What We Offer:\\s*", "concat(chr(10), '🎁 What We Offer:', chr(10))"))
LONG_HEADS = (("(?i)Job Details:\\s*", "concat(repeat(chr(10), 2), '📋 Job Details:', chr(10))"),
              ("(?i)Requirements:\\s*", "concat(repeat(chr(10), 2), '✅ Requirements:', chr(10))"),
              ("(?i)What We Offer:\\s*", "concat(repeat(chr(10), 2), '🎁 What We Offer:', chr(10))"),
              ("(?i)For More Details", "concat(repeat(chr(10), 2), '📞 For More Details')"), ("(?i)Accommodation:", "concat(chr(10), '🏠 Accommodation:')"),
              ("(?i)Salary:", "concat(chr(10), '💰 Salary:')"), ("(?i)Contact:", "concat(chr(10), '📱 Contact:')"))
NOISE = (("\\(adsbygoogle[^)]*\\)[^;]*;", "''"), ("window\\.__CF\\$cv\\$params[^}]*\\}", "''"), ("document\\.createElement[^;]*;", "''"), ("googletag\\.cmd[^;]*;", "''"))
TIDY = (("\\n\\s*\\n\\s*\\n", "repeat(chr(10), 2)"), ("^\\s*\\n+", "''"), ("\\n+\\s*$", "''"))
DESCRIPTION = ("(?i)((?:Hiring|We are looking|Job Details|Position)[\\s\\S]*?)(?:Back|Next|Email to a Friend|Page View Count|© 2025|$)",
               "(?i)((?:Accommodation|Company will provide)[\\s\\S]*?(?:Requirements|What We Offer)[\\s\\S]*?)(?:Back|Next|Email|©|$)")
LAST_PLACE = ", ".join(f"CASE WHEN contains(lower(g.t), '{m}') THEN length(g.t) - instr(reverse(lower(g.t)), reverse('{m}')) - {len(m) - 1} ELSE -1 END"
                       for m in ("back", "next", "email to a friend", "©"))
# A stretch of 200 or more characters without full stop, up to the last end word in it or the end of the text.
LONG_STRETCH = f"""list_filter(list_transform(list_transform(string_split(body_text, '.'), lambda x, i: struct_pack(t := x, last := i = len(string_split(body_text, '.')))),
  lambda g: CASE WHEN g.last AND length(g.t) >= 200 THEN g.t WHEN greatest({LAST_PLACE}) >= 200 THEN substring(g.t, 1, greatest({LAST_PLACE})) END), lambda v: v IS NOT NULL)[1]"""


def longer(a, b):
    return f"CASE WHEN length({b}) > length({a}) THEN {b} ELSE {a} END"


HEADER_STEPS = P.HEADER_END_MARKERS


def header_steps(source):
    out, prev = [], source
    for i, m in enumerate(HEADER_STEPS):
        was = "0" if i == 0 else "st"
        cols = "* REPLACE" if i else "*,"
        new = f"CASE WHEN instr(body_text, '{m}') - 1 > {was} THEN instr(body_text, '{m}') - 1 + {len(m)} ELSE {was} END"
        out.append(f"h{i} AS (SELECT {cols} ({new} AS st) FROM {prev})" if i else f"h{i} AS (SELECT *, {new} AS st FROM {prev})")
        prev = f"h{i}"
    return ", ".join(out)


# The text before the third pattern's end is matched greedily, so its end word is the last one that fits.
FULL_DESCRIPTION = f"""d1 AS (SELECT seq, body_text, {description_sql('body_text', 16, MORE_ENDS)} AS d FROM fx_rich_text),
m AS (SELECT *, regexp_extract(body_text, '{DESCRIPTION[0]}', 1) AS m1, regexp_extract(body_text, '{DESCRIPTION[1]}', 1) AS m2,
  coalesce({LONG_STRETCH}, '') AS m3 FROM d1),
d2 AS (SELECT seq, body_text, CASE WHEN length(d) >= 100 THEN d ELSE {longer(f"({longer(f'({longer('d', 'm1')})', 'm2')})", 'm3')} END AS d FROM m),
{header_steps('d2')},
d3 AS (SELECT seq, d, {until_sql('substring(body_text, st + 1)', ("Back", "Next", "© 2025", "Email to a Friend"))} AS mid FROM h3),
d4 AS (SELECT seq, CASE WHEN length(d) < 50 AND length(mid) > 100 THEN {trim_sql('mid')} ELSE d END AS d FROM d3),
d5 AS (SELECT seq, {re_all(re_all(re_all(re_all('d', CALM), NOISE), LONG_HEADS), TIDY)} AS d FROM d4),
d6 AS (SELECT seq, d, CASE WHEN contains(substring(d, 1, 1501), chr(10)) THEN 1501 - instr(reverse(substring(d, 1, 1501)), chr(10)) ELSE -1 END AS cut FROM d5)"""


@query("description_full", f"""
WITH {FULL_DESCRIPTION} SELECT seq, CASE WHEN length(d) > 1500 AND cut > 1000 THEN substring(d, 1, cut) || repeat(chr(10), 2) || '[...description continues...]'
  WHEN length(d) > 1500 THEN substring(d, 1, 1500) || '...' ELSE d END AS description FROM d6""", R)
def description_full(spark, sf):
    profile = P.full_profile(OWN_DOMAIN)
    return with_full_description(fx_rich_text(spark, sf), profile).select("seq", "description")


@query("format_description", f"""
WITH f AS (SELECT seq, {re_all(re_all('body_text', CALM), SHORT_HEADS)} AS short_form, {re_all(re_all(re_all(re_all('body_text', CALM), NOISE), LONG_HEADS), TIDY)} AS long_form FROM fx_rich_text)
SELECT seq, {CUT.format(x='short_form', n=1000)} AS short_form, long_form FROM f""", R)
def format_description(spark, sf):
    text = F.col("body_text")
    out = fx_rich_text(spark, sf).select("seq", X.format_description(text, "short").alias("short_form"),
                                         X.format_description(text).alias("long_form"))
    return out.withColumn("short_form", X.truncate_text(F.col("short_form"), 1000))


@query("page_description", f"""
WITH f AS (SELECT seq, trim(regexp_replace(concat(body_text, ' {OWN_DOMAIN} footer'), '\\s+', ' ', 'g')) AS flat FROM fx_posting_text),
c AS (SELECT seq, {until_sql('flat', ('Verify you are human', OWN_DOMAIN))} AS d FROM f)
SELECT seq, CASE WHEN length(d) > 100 THEN {CUT.format(x='d', n=500)} ELSE '' END AS description FROM c""", T)
def page_description(spark, sf):
    text = F.concat("body_text", F.lit(f" {OWN_DOMAIN} footer"))
    return fx_posting_text(spark, sf).select("seq", X.page_description(text, OWN_DOMAIN).alias("description"))


REQUIREMENTS = ("(?i)((?:✅\\s*)?Requirements:[\\s\\S]*?)(?:What We Offer|Benefits|For More Details|Contact|Salary|Position|Back|Next|\\n\\n[A-Z]|$)",
                "(?i)((?:Valid And Transferable|Experience required|Must have)[\\s\\S]*?)(?:What We Offer|Benefits|For More Details|Communication|Contact|$)",
                "(?i)((?:Qualifications|Minimum requirements)[\\s\\S]*?)(?:What We Offer|Benefits|For More Details|$)",
                "(?i)((?:Education|Experience).*?(?:required|needed|must)[\\s\\S]*?)(?:What We Offer|Benefits|For More Details|$)")
BENEFITS = ("(?i)((?:🎁\\s*)?What We Offer:[\\s\\S]*?)(?:Requirements|For More Details|Contact|Back|Next|\\n\\n[A-Z]|$)",
            "(?i)((?:Competitive fixed salary|Company will provide|Benefits include)[\\s\\S]*?)(?:Requirements|For More Details|Contact|$)",
            "(?i)((?:Accommodation|Housing|Medical|Insurance)[\\s\\S]*?(?:provided|included|covered)[\\s\\S]*?)(?:Requirements|For More Details|Contact|$)")


def section_sql(col, patterns, label, bullet, low, high):
    cleaned = []
    for p in patterns:
        flat = f"trim(regexp_replace(regexp_extract({col}, '{p}', 1), '\\s+', ' ', 'g'))"
        flat = f"regexp_replace({flat}, '{label}', '')"
        for pattern in (f"{bullet}\\s*", None):
            if pattern:
                flat = f"regexp_replace({flat}, '{pattern}', '• ', 'g')"
        flat = f"regexp_replace({flat}, '(?:^|\\n)\\s*[-•*]\\s*', chr(10) || '• ', 'g')"
        cleaned.append(trim_sql(f"regexp_replace({flat}, '(?:^|\\n)\\s*\\d+\\.\\s*', chr(10) || '• ', 'g')"))
    return f"coalesce(list_filter([{', '.join(cleaned)}], lambda x: length(x) BETWEEN {low} AND {high})[1], '')"


def requirements_sql(col):
    return section_sql(col, REQUIREMENTS, "(?i)(?:✅\\s*)?Requirements:\\s*", "✅", 31, 599)


def benefits_sql(col):
    return section_sql(col, BENEFITS, "(?i)(?:🎁\\s*)?What We Offer:\\s*", "🎁", 21, 499)


@query("extract_requirements", f"SELECT seq, {requirements_sql('body_text')} AS requirements FROM fx_posting_text", T)
def extract_requirements(spark, sf):
    return fx_posting_text(spark, sf).select("seq", X.requirements(F.col("body_text")).alias("requirements"))


@query("extract_benefits", f"SELECT seq, {benefits_sql('body_text')} AS benefits FROM fx_posting_text", T)
def extract_benefits(spark, sf):
    return fx_posting_text(spark, sf).select("seq", X.benefits(F.col("body_text")).alias("benefits"))


@query("sections_rich", f"""
SELECT seq, {requirements_sql('body_text')} AS requirements, {benefits_sql('body_text')} AS benefits,
  {trim_sql("substring(regexp_extract(body_text, '(?i)((?:Requirements?|Qualifications?):[\\s\\S]*?)(?:What We Offer|Benefits|Contact|$)', 1), 1, 300)")} AS capped_requirements,
  {trim_sql("substring(regexp_extract(body_text, '(?i)((?:What We Offer|Benefits?):[\\s\\S]*?)(?:Requirements|Contact|$)', 1), 1, 300)")} AS capped_benefits,
  substring(trim(regexp_replace(regexp_extract(body_text, '(?i)(Requirements:[\\s\\S]*?)(?:What We Offer|For More Details|Contact|$)', 1), '\\s+', ' ', 'g')), 1, 300) AS flat_requirements
FROM (SELECT seq, concat(body_text, chr(10), CASE WHEN seq % 3 = 0 THEN 'Requirement: ' ELSE '✅ Requirements: ' END,
  repeat('- iqama and license ', CAST(seq % 40 AS INT)), chr(10), 'What We Offer: housing', chr(10)) AS body_text FROM fx_rich_text)""", R)
def sections_rich(spark, sf):
    seq, text = F.col("seq"), F.col("body_text")
    more = fx_rich_text(spark, sf).select("seq", F.concat(
        text, F.lit("\n"), F.when(seq % 3 == 0, "Requirement: ").otherwise("✅ Requirements: "),
        F.expr("repeat('- iqama and license ', CAST(seq % 40 AS INT))"), F.lit("\nWhat We Offer: housing\n")).alias("body_text"))
    return more.select(
        "seq", X.requirements(text).alias("requirements"), X.benefits(text).alias("benefits"),
        X.capped_section(text, P.CAPPED_REQUIREMENTS).alias("capped_requirements"),
        X.capped_section(text, P.CAPPED_BENEFITS).alias("capped_benefits"),
        X.capped_section(text, P.SQUEEZED_REQUIREMENTS, flat=True).alias("flat_requirements"))


DETAILS_SQL = f"""
WITH r AS (SELECT seq, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM fx_rich_text),
k AS (SELECT seq, i, {trim_sql("string_split(line, ':')[1]")} AS key, {trim_sql("string_split(line, ':')[2]")} AS value FROM r WHERE contains(line, ':')),
f AS (SELECT seq, i, regexp_replace(lower(key), '\\s+', '_', 'g') AS key, value FROM k
  WHERE key <> '' AND value <> '' AND length(key) < 50 AND length(value) < 200)
SELECT seq, key, arg_max(value, i) AS value FROM f GROUP BY 1, 2"""


@query("details_map", DETAILS_SQL, R)
def details_map(spark, sf):
    lines = text_lines(F.col("body_text"))
    return fx_rich_text(spark, sf).select("seq", F.explode(X.details_map(lines)).alias("key", "value"))


@query("details_of_blocks", DETAILS_SQL, R)
def details_of_blocks(spark, sf):
    """Lines as table rows and detail blocks of a page: they are read in the order of the page, whatever rule fits them."""
    def block(line, i):
        inner = F.concat(F.lit("<i>"), line, F.lit("</i>"))
        return (F.when(i % 3 == 0, F.concat(F.lit("<table><tr><td>"), inner, F.lit("</td></tr></table>")))
                .when(i % 3 == 1, F.concat(F.lit("<div class='a listing-detail'><div>"), inner, F.lit("</div></div>")))
                .otherwise(F.concat(F.lit("<p class=detail-item>"), inner, F.lit("</p>"))))

    html = F.array_join(F.transform(text_lines(F.col("body_text")), block), "")
    rows = computed_once(fx_rich_text(spark, sf).select("seq", html.alias("html")),
                         {"parts": page_parts(F.col("html"), rows=X.detail_pick())}, ["seq"])
    return rows.select("seq", F.explode(X.details_map(F.col("parts.rows"))).alias("key", "value"))


def label_sql(k):
    return f"nullif(regexp_extract(lower(body_text), '{k}[\\s:]+([^.\\n]+)', 1), '')"


@query("labelled_lower", "SELECT seq, " + ", ".join(f"{label_sql(k)} AS {k}" for k in P.LOWER_LABELS) + """,
  regexp_extract(lower(body_text), '(full[\\s-]?time|part[\\s-]?time|contract|temporary|permanent)', 1) AS employment_type FROM fx_rich_text""", R)
def labelled_lower(spark, sf):
    text = F.col("body_text")
    return fx_rich_text(spark, sf).select("seq", *[X.labelled_lower(text, k).alias(k) for k in P.LOWER_LABELS],
                                          tags.employment_type_loose(text).alias("employment_type"))


def line_rule(words, pattern, below):
    value = trim_sql(f"regexp_extract(s, '{pattern}', 1)")
    return (f"CASE WHEN regexp_matches(lower(s), '{words}') AND contains(s, ':') AND regexp_matches(s, '{pattern}') "
            f"AND length({value}) < {below} THEN {value} END")


CITY = ("CASE " + " ".join(f"WHEN contains(lower(s), '{c}') THEN '{c.capitalize()}'" for c in P.CITIES) + " END")


@query("labelled_lines", f"""
SELECT seq, {last_sql(line_rule('company|employer|organization', '(?i)(?:company|employer|organization)[\\s:]+(.+)', 100))} AS company,
  {last_sql(line_rule('experience', '(?i)experience[\\s:]+(.+)', 100))} AS experience,
  {last_sql(line_rule('education|qualification|degree', '(?i)(?:education|qualification|degree)[\\s:]+(.+)', 100))} AS education,
  {last_sql(f"coalesce({CITY}, {line_rule('location|city|area', '(?i)(?:location|city|area)[\\s:]+(.+)', 50)})")} AS location FROM fx_rich_text""", R)
def labelled_lines(spark, sf):
    text = F.col("body_text")
    return fx_rich_text(spark, sf).select(
        "seq", X.labelled_in(text, P.COMPANY_LINE).alias("company"), X.labelled_in(text, P.EXPERIENCE_LINE).alias("experience"),
        X.labelled_in(text, P.EDUCATION_LINE).alias("education"), X.location_in(text).alias("location"))


@query("detect_city", f"SELECT seq, {last_sql(CITY)} AS city FROM fx_rich_text", R)
def detect_city(spark, sf):
    return fx_rich_text(spark, sf).select("seq", tags.detect_city(text_lines(F.col("body_text"))).alias("city"))


TITLE_PHRASES = ("(?i)Hiring For ([^\\n\\r]+)", "(?i)Position: ([^\\n\\r]+)", "(?i)Job Title: ([^\\n\\r]+)", "(?i)Looking for ([^\\n\\r]+)")
PHRASE = [trim_sql(f"regexp_extract(body_text, '{p}', 1)") for p in TITLE_PHRASES]


@query("titles", f"""
WITH t AS (SELECT seq, body_text, CASE WHEN seq % 3 = 0 THEN 'x | Jobs' ELSE concat('Post ', CAST(seq AS STRING), ' | Jobs - {OWN_DOMAIN} pages') END AS page_title,
    CASE WHEN seq % 6 = 0 THEN 'B' ELSE ' Heading text ' END AS heading FROM fx_rich_text),
b AS (SELECT *, {trim_sql(f"regexp_replace(regexp_replace(page_title, '(?i)\\s*-\\s*listings\\.example\\.com[^\\n\\r]*$', ''), '\\s*\\|[^\\n\\r]*$', '')")} AS bare FROM t),
s AS (SELECT *, CASE WHEN length(bare) < 3 THEN trim(heading) ELSE bare END AS two FROM b),
p AS (SELECT seq, CASE WHEN length(two) < 3 THEN list_filter({LINES}, lambda l: length(l) BETWEEN 6 AND 99)[1] ELSE two END AS title,
    bare, {PHRASE[0]} AS p1, {PHRASE[1]} AS p2 FROM s)
SELECT seq, title, {longer(f"({longer('bare', 'p1')})", 'p2')} AS phrase_title FROM p""", R)
def titles(spark, sf):
    seq = F.col("seq")
    page_title = F.when(seq % 3 == 0, "x | Jobs").otherwise(
        F.concat(F.lit("Post "), seq.cast("string"), F.lit(f" | Jobs - {OWN_DOMAIN} pages")))
    df = fx_rich_text(spark, sf).select("seq", "body_text", page_title.alias("page_title"),
                                        F.when(seq % 6 == 0, "B").otherwise(" Heading text ").alias("heading"))
    bare = F.regexp_replace(X.without_site_suffix(F.col("page_title"), OWN_DOMAIN), r"\s*\|.*$", "")
    return df.select("seq", X.title_fallback(F.col("page_title"), F.col("heading"), text_lines(F.col("body_text")), OWN_DOMAIN).alias("title"),
                     X.title_from_text(bare, F.col("body_text")).alias("phrase_title"))


SKILL_SQL = "[" + ", ".join(f"'{w}'" for w in P.SKILLS) + "]"


@query("tag_skills", f"""
WITH s AS (SELECT unnest(list_filter({SKILL_SQL}, lambda w: contains(lower(body_text), w))) AS skill FROM fx_rich_text)
SELECT skill, count(*) AS n FROM s GROUP BY 1""", R)
def tag_skills(spark, sf):
    tagged = fx_rich_text(spark, sf).select(F.explode(tags.tag_skills(F.col("body_text"))).alias("skill"))
    return tagged.groupBy("skill").agg(F.count("*").alias("n"))


@query("skills_in_documents", f"""
SELECT doc_id, array_to_string(list_filter({SKILL_SQL}, lambda w: contains(lower(text), w)), ',') AS skills FROM documents""")
def skills_in_documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.array_join(tags.tag_skills(F.col("text")), ",").alias("skills"))


def words_sql(col, words):
    return "CASE " + " ".join(f"WHEN contains(lower({col}), '{w}') THEN '{w}'" for w in words) + " ELSE '' END"


@query("employment_type", f"""
SELECT seq, {words_sql('body_text', P.EMPLOYMENT_2)} AS two, {words_sql('body_text', P.EMPLOYMENT_5)} AS five, {words_sql('body_text', P.EMPLOYMENT_7)} AS seven,
  regexp_extract(lower(body_text), '(full[\\s-]?time|part[\\s-]?time|contract|temporary|permanent)', 1) AS loose FROM fx_posting_text""", T)
def employment_type(spark, sf):
    text = F.col("body_text")
    return fx_posting_text(spark, sf).select(
        "seq", tags.employment_type(text, P.EMPLOYMENT_2).alias("two"), tags.employment_type(text, P.EMPLOYMENT_5).alias("five"),
        tags.employment_type(text, P.EMPLOYMENT_7).alias("seven"), tags.employment_type_loose(text).alias("loose"))


@query("emails_in_documents", f"SELECT doc_id, {email_sql('text')} AS email FROM documents WHERE {email_sql('text')} <> ''")
def emails_in_documents(spark, sf):
    found = computed_once(spread(table(spark, sf, "documents")), {"email": X.email(F.col("text"), OWN_DOMAIN)}, ["doc_id"])
    return found.where(F.col("email") != "")


@query("phones_in_documents", f"""
WITH c AS (SELECT doc_id, {all_sql('text', PHONES)} AS l FROM documents) SELECT doc_id, {once_joined('l')} AS contact FROM c WHERE len(l) > 0""")
def phones_in_documents(spark, sf):
    found = computed_once(spread(table(spark, sf, "documents")), {"contact": X.contacts(F.col("text"))}, ["doc_id"])
    return found.where(F.col("contact") != "")


# --- whole records ------------------------------------------------------------------

PAGE_TITLE = f"concat(location, ' Jobs, ', title, ', ', CAST(seq AS STRING), ' - {OWN_DOMAIN} classifieds')"
PAGES_CTE = f"""pg AS (SELECT url, body_text, {PAGE_TITLE} AS page_title FROM fx_posting_text WHERE NOT {CHALLENGE})"""
CLEAN_TITLE = trim_sql("regexp_replace(regexp_replace(" + trim_sql(
    "regexp_replace(page_title, '(?i)\\s*-\\s*listings\\.example\\.com[^\\n\\r]*$', '')") + ", '^.*?Jobs,\\s*', ''), ',\\s*\\d+$', '')")


def posting_pages(spark, sf):
    return fx_posting_text(spark, sf).select("url", "body_text", F.expr(PAGE_TITLE).alias("page_title"))


def record_sql(full):
    n_salary, n_location, n_phone = (3, 3, 3) if full else (4, 4, 4)
    ids, posted = (IDS[:1], POSTED[:1]) if full else (IDS, POSTED)
    phones = all_sql("body_text", PHONES[:n_phone])
    description = "description" if full else CUT.format(x="description", n=1000)
    base = re_all(re_all(description_sql("body_text", 16), CALM), SHORT_HEADS)
    inner = f"""SELECT {CLEAN_TITLE} AS title, {cascade('body_text', SALARY[:n_salary])} AS salary, {once_joined(phones)} AS contact, {email_sql('body_text')} AS email,
  {trim_sql(cascade('body_text', LOCATION[:n_location]))} AS location, coalesce(nullif({cascade('body_text', ids)}, ''), regexp_extract(url, 'cls/(\\d+)\\.html', 1)) AS posting_id,
  {trim_sql(cascade('body_text', posted))} AS posted_date,
  {trim_sql("regexp_extract(body_text, '(?i)Category:\\s*([^\\n\\r]+)', 1)") if full else "''"} AS category,
  {words_sql('body_text', P.EMPLOYMENT_2) if full else "''"} AS employment_type, '' AS company,
  {requirements_sql('body_text') if full else "''"} AS requirements, {benefits_sql('body_text') if full else "''"} AS benefits,
  {base} AS description, url, '{STAMP}' AS scraped_at, 'No' AS is_sponsored FROM pg"""
    return f"WITH {PAGES_CTE} SELECT * REPLACE ({description} AS description) FROM ({inner})"


@query("extract_postings", record_sql(False), T)
def extract_records(spark, sf):
    return extract_postings(posting_pages(spark, sf), P.primary_profile(OWN_DOMAIN), STAMP)


@query("extract_full_records", f"SELECT * EXCLUDE (description) FROM ({record_sql(True)})", T)
def extract_full_records(spark, sf):
    return extract_postings(posting_pages(spark, sf), P.full_profile(OWN_DOMAIN), STAMP).select(
        *[c for c in POSTING_COLUMNS if c != "description"])


HTML = """concat('<html><head><title>', title, ' | Jobs</title></head><body><h1>', title, '</h1><table><tr><td>Salary: ', salary,
  '</td></tr>', chr(10), '<tr><td>Work site: ', location, '</td></tr><tr><td>', body_text, '</td></tr></table><time datetime="2025-06-29T21:09:17">now</time></body></html>')"""
HTML_TEXT = f"""x AS (SELECT seq, title, salary, location, url, concat(title, 'Salary: ', salary, chr(10), 'Work site: ', location, t.body_text, 'now') AS body_text,
  concat('Salary: ', salary, chr(10), 'Work site: ', location, t.body_text) AS table_text FROM fx_rich_text t)"""


def record_pages(spark, sf):
    return fx_rich_text(spark, sf).select("url", F.expr(HTML).alias("html"))


@query("skills_records", f"""
WITH {HTML_TEXT}, l AS (SELECT * FROM x WHERE NOT {CHALLENGE})
SELECT regexp_replace(string_split(url, '/')[-1], '\\.html', '') AS id, nullif(regexp_extract(url, '/cls/(\\d+)', 1), '') AS job_id, title, url,
  CASE WHEN length({trim_sql('table_text')}) > 100 THEN trim(regexp_replace(table_text, '\\s+', ' ', 'g')) ELSE '' END AS description,
  coalesce({last_sql(f"coalesce({CITY}, {line_rule('location|city|area', '(?i)(?:location|city|area)[\\s:]+(.+)', 50)})")}, 'Saudi Arabia') AS location,
  {last_sql(f"CASE WHEN regexp_matches(lower(s), 'salary|wage|sr|sar') AND (contains(s, ':') OR regexp_matches(s, '[0-9]')) THEN {trim_sql(LINE_SALARY)} END")} AS salary,
  {last_sql(line_rule('company|employer|organization', '(?i)(?:company|employer|organization)[\\s:]+(.+)', 100))} AS company,
  nullif({words_sql('body_text', P.EMPLOYMENT_7)}, '') AS employment_type,
  {last_sql(line_rule('experience', '(?i)experience[\\s:]+(.+)', 100))} AS experience,
  {last_sql(line_rule('education|qualification|degree', '(?i)(?:education|qualification|degree)[\\s:]+(.+)', 100))} AS education,
  array_to_string(list_filter({SKILL_SQL}, lambda w: contains(lower(body_text), w)), ',') AS skills, '2025-06-29T21:09:17' AS posted_date,
  '{STAMP}' AS scraped_at FROM l""", R)
def skills_records(spark, sf):
    out = extract_postings(record_pages(spark, sf), P.skills_profile(OWN_DOMAIN), STAMP)
    return out.withColumn("skills", F.array_join("skills", ",")).drop("contact")


@query("keyed_records", f"""
WITH {HTML_TEXT}, l AS (SELECT * FROM x WHERE NOT {CHALLENGE})
SELECT title, url, coalesce(regexp_extract(lower(body_text), 'location[\\s:]+([^.\\n]+)', 1), '') AS text_location,
  {label_sql('salary')} AS salary, coalesce({label_sql('experience')}, NULL) AS experience, {label_sql('company')} AS company,
  nullif(regexp_extract(lower(body_text), '(full[\\s-]?time|part[\\s-]?time|contract|temporary|permanent)', 1), '') AS employment_type,
  {label_sql('education')} AS education, {label_sql('skills')} AS skills, substring(body_text, 1, 1000) AS full_text,
  nullif({trim_sql('location')}, '') AS work_site, 'job_detail' AS type, '{STAMP}' AS scraped_at FROM l""", R)
def keyed_records(spark, sf):
    out = extract_postings(record_pages(spark, sf), P.keyed_profile(OWN_DOMAIN), STAMP)
    return out.select("title", "url", F.coalesce(F.regexp_extract(F.lower("full_text"), r"location[\s:]+([^.\n]+)", 1), F.lit("")).alias("text_location"),
                      "salary", "experience", "company", "employment_type", "education", "skills", "full_text",
                      F.try_element_at("additional_details", F.lit("work_site")).alias("work_site"), "type", "scraped_at")
