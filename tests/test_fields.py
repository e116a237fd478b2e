"""Fields of one posting written for this test; all names, numbers and addresses are invented."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.elements import Selector, page_parts
from jobsieve.functions.text import text_lines
from jobsieve.operators.extract import extract_postings, with_page_text
from jobsieve.schema import POSTING_COLUMNS

DOMAIN = "listings.example.com"
POSTING = """
Region: Dammam (Dammam)
Category: Jobs
Posting ID: 48210077
Posted: Tuesday, Mar 4, 2025, 7:30:05 AM
From: desk@mail.example.com
 Chat on WhatsApp
Night nurse for a small clinic by the sea

What We Offer:
• A room near the clinic
• Two free days each week

Salary: 4150
Part-time, six hours a night
Location: [Dammam]

Requirements:
• A nursing diploma and three years on a ward
• Good English and some Arabic, driving is no must

Write or ring 0551112223, abroad +966544455566
Next
"""
URL = "https://listings.example.com/cls/48210077.html"
T = F.col("body_text")


def get(spark, column, text=POSTING, url=URL):
    df = spark.createDataFrame([(text, url)], "body_text string, url string")
    return df.select(column.alias("v")).first()["v"]


def test_core_fields(spark):
    assert get(spark, X.salary(T)) == "4150"
    assert get(spark, X.location(T)) == "Dammam"
    assert get(spark, X.posting_id(T, F.col("url"))) == "48210077"
    assert get(spark, X.email(T, DOMAIN)) == "desk@mail.example.com"
    assert get(spark, X.category(T)) == "Jobs"
    assert get(spark, X.contacts(T)) == "0551112223, +966544455566"
    assert get(spark, tags.employment_type(T)) == "part-time"
    assert get(spark, tags.tag_skills(T)) == ["english", "arabic", "driving", "nursing"]
    date = X.posted_date(T)
    assert get(spark, date) == "Tuesday, Mar 4, 2025, 7:30:05 AM"
    assert get(spark, X.posted_at(date)) == dt.datetime(2025, 3, 4, 7, 30, 5)


def test_phone_bounds_are_ascii(spark):
    assert get(spark, X.contacts(T), "é0512345678 x0512345678 05123456789") == "0512345678"


def test_email_of_the_site_is_skipped(spark):
    text = "From: a@listings.example.com\nEmail: b@mail.example.com"
    assert get(spark, X.email(T, DOMAIN), text) == "b@mail.example.com"


def test_posted_date_keeps_the_whole_date(spark):
    assert get(spark, X.posted_date(T), "on Jul 3, 2025 we hire") == "Jul 3, 2025"
    assert get(spark, X.posted_at(X.posted_date(T)), "on Jul 3, 2025 we hire") is None


def test_sections(spark):
    wanted = get(spark, X.requirements(T))
    assert wanted.startswith("• A nursing diploma") and wanted.endswith("driving is no must")
    assert get(spark, X.benefits(T)) == "• A room near the clinic • Two free days each week"
    assert get(spark, X.requirements(T), "Requirements: short") == ""
    long_text = "Requirements: " + "word " * 200
    assert get(spark, X.requirements(T), long_text) == ""


def test_section_ends_at_an_empty_line(spark):
    text = "Requirements: a licence and two years of work\n\nother text"
    assert get(spark, X.requirements(T), text) == "a licence and two years of work"


def test_sections_equal_the_single_regex_form(spark):
    cases = [POSTING, POSTING.upper(), "experience abroad required and more\nBenefits", "", "Requirements:",
             "Must have a car\nand time. Communication", "x" * 50_000 + "Requirements: " + "y " * 60_000 + "Back"]
    stops = r"What We Offer|Benefits|For More Details|Contact|Salary|Position|Back|Next|\n\n[A-Z]|\z"
    pattern = rf"(?i)Requirements:[\s\S]*?(?={stops})"
    df = spark.createDataFrame([(c,) for c in cases], "body_text string")
    both = df.select(X.rule_section(T, P.REQUIREMENTS_RULES[0]), F.regexp_extract(T, pattern, 0)).collect()
    assert all(a == b for a, b in both)


def test_description(spark):
    text = get(spark, X.description(T))
    assert text.startswith("Night nurse for a small clinic") and text.endswith("+966544455566")
    assert get(spark, X.description(T, marker_skip=20)).startswith("ht nurse")
    assert get(spark, X.description(T), "no marker") == ""
    assert "\n✅ Requirements:\n" in get(spark, X.format_description(X.description(T), "short"))


def test_truncation(spark):
    text = "a" * 1200 + "\n" + "b" * 800
    cut = get(spark, X.truncate_text(T, 1500, 1000), text)
    assert cut == "a" * 1200 + P.CONTINUED
    assert get(spark, X.truncate_text(T, 1500, 1300), text) == text[:1500] + "..."
    assert get(spark, X.truncate_text(T, 3000, 1000), text) == text


def test_long_stretch_starts_at_a_full_stop(spark):
    text = "a. b" + "c" * 250 + " Back " + "d" * 20 + " Next e."
    assert get(spark, F.regexp_extract(T, P.LONG_STRETCH, 0), text) == " b" + "c" * 250 + " Back " + "d" * 20 + " "


def test_lines(spark):
    text = "Company: First\nX\nEmployer: Last Ltd\nContact: 055 123 45678\nContact: a@b.example\nCity: Taif\nin Abha now"
    lines = text_lines(T)
    assert get(spark, X.labelled(lines, P.COMPANY_LINE), text) == "Last Ltd"
    assert get(spark, X.contact_of_lines(lines), text) == "a@b.example"
    assert get(spark, X.line_location(lines), text) == "Abha"
    assert get(spark, X.labelled(lines, P.EDUCATION_LINE), text) is None


def test_details_map_last_value_and_second_colon(spark):
    rows = F.array(F.lit("Work Site: A"), F.lit("work site: B : C"), F.lit("no colon"), F.lit(": x"))
    assert get(spark, X.details_map(rows)) == {"work_site": "B"}


def test_titles(spark):
    t = F.lit("Saudi Jobs, Driver needed, 59000001 - listings.example.com classifieds")
    assert get(spark, X.clean_title(t, DOMAIN)) == "Driver needed"
    assert get(spark, X.title_from_text(F.lit("Cook"), T), "Position: Cook for a hotel\n") == "Cook for a hotel"


def test_blocks(spark):
    html = ('<h1> </h1><div class="job-title big">Nurse</div><p>short</p><p>' + "word " * 20 + "</p>"
            '<table><tr><td>Grade: A</td></tr></table><div class="date">29/06/2025</div>')
    parts = page_parts(T, title=X.title_pick(), block=X.block_pick(), **X.block_picks((Selector(tag="p"),), 50))
    assert get(spark, parts["title"], html) == "Nurse"
    assert get(spark, parts["block"], html) == ("word " * 20).strip()
    assert get(spark, X.longest_block(parts), html) == ("word " * 20).strip()
    assert get(spark, X.datetime_of_page(T), html) == "29/06/2025"
    assert get(spark, X.datetime_of_page(T), '<time class="date" datetime="2025-06-29">x</time>') == "2025-06-29"
    assert get(spark, parts["title"], "<p>x</p>") is None


def test_records_of_all_profiles(spark):
    html = f"<html><head><title>KSA Jobs, Nurse, 1 - {DOMAIN}</title></head><body><h1>Nurse</h1>{POSTING}<script>var x='Company: no';</script></body></html>"
    challenge = "<html><head><title>x</title></head><body>Verify you are human</body></html>"
    pages = spark.createDataFrame([(1, URL, html), (2, URL + "?2", challenge)], "page_id bigint, url string, html string")
    for profile in (P.primary_profile(DOMAIN), P.full_profile(DOMAIN)):
        rows = extract_postings(pages, profile, "now").collect()
        assert len(rows) == 1 and list(rows[0].asDict()) == list(POSTING_COLUMNS)
        assert rows[0]["title"] == "Nurse" and rows[0]["salary"] == "4150" and rows[0]["scraped_at"] == "now"
    assert rows[0]["benefits"].startswith("• A room near the clinic") and "💰 Salary:" in rows[0]["description"]
    skilled = extract_postings(pages, P.skills_profile(DOMAIN), "now").first()
    assert skilled["location"] == "Dammam" and skilled["company"] is None and "english" in skilled["skills"]
    keyed = extract_postings(pages, P.keyed_profile(DOMAIN), "now").first()
    assert keyed["title"] == "Nurse" and keyed["additional_details"]["salary"] == "4150"
    assert "var x" in with_page_text(pages, keep_scripts=True).first()["body_text"]


@pytest.mark.parametrize("field, opening", [
    ("requirements", "Education "), ("benefits", "Medical "), ("benefits", "Accommodation\n"), ("requirements", "Experience x "),
    ("description", "Accommodation x\n")])
def test_recurring_openings_take_linear_time(spark, field, opening):
    import time

    column = {"requirements": X.requirements(T), "benefits": X.benefits(T), "description": X.longest_description(F.lit(""), T)}[field]

    def took(n):
        df = spark.createDataFrame([(opening * (n // len(opening)),)] * 4, "body_text string").coalesce(1)
        best = 99
        for _ in range(3):
            start = time.perf_counter()
            df.select(F.length(column).alias("n")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    assert took(256_000) < 6 * took(64_000) + 0.3


def test_first_opening_of_a_line_or_text(spark):
    text = "Experience of years\nEducation level, Education needed here for all staff at the site\nWhat We Offer: x"
    assert get(spark, X.rule_section(T, P.REQUIREMENTS_RULES[3]), text) == "Education level, Education needed here for all staff at the site\n"
    text = "Housing and\nMedical, all provided by us Contact"
    assert get(spark, X.rule_section(T, P.BENEFITS_RULES[2]), text) == "Housing and\nMedical, all provided by us "
    assert get(spark, X.rule_section(T, P.BENEFITS_RULES[2]), "Housing, Medical") == ""
