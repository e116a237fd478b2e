"""Page snapshots to posting records, in a few projections over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsieve.functions import fields as X
from jobsieve.functions import profile as P
from jobsieve.functions import tags
from jobsieve.functions.bytewise import column, first_word, words_found
from jobsieve.functions.elements import BodyText, Pick, Selector, page_parts
from jobsieve.functions.html import body_text, document_title
from jobsieve.functions.profile import ExtractionProfile
from jobsieve.functions.text import blank_to_null, iso_utc, text_lines
from jobsieve.schema import POSTING_COLUMNS


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Adds columns whose costly expressions are evaluated once for each row.

    Catalyst copies the expression of a plain column into every filter above it, and then
    evaluates it in both places. The output of a generator is not copied.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*(df.columns if keep is None else keep), F.inline(F.array(row)))


def with_page_text(pages: DataFrame, html: str = "html", keep_scripts: bool = False, drop_html: bool = True) -> DataFrame:
    """Adds `page_title` and `body_text`. The HTML is dropped unless block fields need it."""
    keep = [c for c in pages.columns if not (drop_html and c == html)]
    return computed_once(pages, {
        "page_title": document_title(F.col(html)),
        "body_text": body_text(F.col(html), keep_scripts),
    }, keep)


def drop_challenge(pages: DataFrame, text: str = "body_text") -> DataFrame:
    """Pages that show content instead of an interstitial."""
    return pages.where(~tags.is_challenge(F.col(text)))


def with_challenge_flag(pages: DataFrame, title: str = "page_title", text: str = "body_text") -> DataFrame:
    return pages.withColumn("is_challenge", tags.challenge_flag(F.col(title), F.col(text)))


def with_extraction_ok(df: DataFrame, own_host: str, text: str = "body_text", title: str = "title") -> DataFrame:
    """Flags failed extractions and says why; the rows stay."""
    t = F.col(title)
    error = (F.when(F.col(text).isNull() | tags.is_challenge(F.col(text)), "interstitial page")
             .when(F.coalesce(t, F.lit("")) == "", "no title").when(t == own_host, "title is the host name"))
    return df.withColumn("error", error).withColumn("extraction_ok", F.col("error").isNull())


def with_full_description(df: DataFrame, profile: ExtractionProfile, text: str = "body_text") -> DataFrame:
    """Adds `description` by marker, then by content patterns, then between header and footer."""
    return df.withColumn("description", X.full_description(F.col(text), profile))


def _stamp(scraped_at: Column | str | None) -> Column:
    if scraped_at is None:
        return iso_utc(F.current_timestamp())
    return F.lit(scraped_at) if isinstance(scraped_at, str) else scraped_at


def _posting_fields(p: ExtractionProfile) -> dict[str, Column]:
    text, url = F.col("body_text"), F.col("url")
    out = {
        "title": X.clean_title(F.col("page_title"), p.own_domain),
        "salary": X.salary(text, p.salary_patterns),
        "contact": X.contacts(text, p.phone_patterns),
        "email": X.email(text, p.own_domain, p.email_patterns),
        "location": X.location(text, p.location_patterns),
        "posting_id": X.posting_id(text, url, p.posting_id_patterns),
        "posted_date": X.posted_date(text, p.posted_patterns),
        "category": F.lit(""),
        "employment_type": F.lit(""),
        "company": F.lit(""),
        "requirements": F.lit(""),
        "benefits": F.lit(""),
    }
    if p.kind == "full":
        out.update({
            "category": X.category(text),
            "employment_type": tags.employment_type(text, p.employment_words),
            "requirements": X.requirements(text),
            "benefits": X.benefits(text),
        })
    return out


def extract_postings(pages: DataFrame, profile: ExtractionProfile, scraped_at: Column | str | None = None,
                     is_sponsored: Column | None = None) -> DataFrame:
    """Posting records of page snapshots.

    `pages` has `url` and either `html` or `page_title` and `body_text` (and `html` for the
    `skills` and `keyed` kinds). Interstitial pages give no record.
    """
    stamp = _stamp(scraped_at)
    if profile.kind == "skills":
        return _skills_records(pages, profile, stamp)
    if profile.kind == "keyed":
        return _keyed_records(pages, profile, stamp)
    if "body_text" not in pages.columns:
        pages = with_page_text(pages)
    pages = drop_challenge(pages)
    sponsored = F.lit("No") if is_sponsored is None else is_sponsored
    keep = ["url", "body_text"]
    out = pages.select(*keep, sponsored.alias("is_sponsored"),
                       *[c.alias(name) for name, c in _posting_fields(profile).items()])
    if profile.kind == "full":
        out = with_full_description(out, profile)
    else:
        text = X.description(F.col("body_text"), profile.marker, profile.marker_skip, profile.end_markers)
        out = out.withColumn("description", X.short_description_format(text))
        out = out.withColumn("description", X.truncate_text(F.col("description"), 1000))
    return out.withColumn("scraped_at", stamp).select(*POSTING_COLUMNS)


def _with_parts(pages: DataFrame, **picks: Pick) -> DataFrame:
    """Adds `parts`, and `page_title` and `body_text` where the pages have none, in one walk; interstitial pages drop out."""
    html = F.col("html")
    if "body_text" in pages.columns:
        return computed_once(drop_challenge(pages), {"parts": page_parts(html, **picks)})
    out = computed_once(pages, {"parts": page_parts(html, text=BodyText(), **picks)})
    # The walk leaves the text of odd pages to the expression for it.
    return drop_challenge(computed_once(out, {
        "page_title": document_title(html), "body_text": F.coalesce(F.col("parts.text"), body_text(html))}))


def _skills_records(pages: DataFrame, p: ExtractionProfile, stamp: Column) -> DataFrame:
    html, text, url = F.col("html"), F.col("body_text"), F.col("url")
    lines = text_lines(text)
    out = _with_parts(pages, heading=Pick((Selector(tag="h1"),), "first"), **X.block_picks())
    parts = F.col("parts")
    return out.select(
        X.url_tail(url).alias("id"), X.job_id(url).alias("job_id"),
        X.title_fallback(F.col("page_title"), F.coalesce(parts["heading"], F.lit("")), lines,
                         p.own_domain).alias("title"),
        "url", X.longest_block(parts).alias("description"),
        F.coalesce(X.location_in(text, p.cities), F.lit(p.default_location)).alias("location"),
        X.salary_phrase(text, "lines").alias("salary"), X.labelled_in(text, P.COMPANY_LINE).alias("company"),
        X.contact_of_lines(lines).alias("contact"),
        blank_to_null(column(first_word(p.employment_words), text)).alias("employment_type"),
        X.labelled_in(text, P.EXPERIENCE_LINE).alias("experience"),
        X.labelled_in(text, P.EDUCATION_LINE).alias("education"), words_found(text, p.skills).alias("skills"),
        X.datetime_of_page(html).alias("posted_date"), stamp.alias("scraped_at"))


def _keyed_records(pages: DataFrame, p: ExtractionProfile, stamp: Column) -> DataFrame:
    text, parts = F.col("body_text"), F.col("parts")
    out = _with_parts(pages, title=X.title_pick(), block=X.block_pick(), rows=X.detail_pick()).select(
        F.coalesce(parts["title"], F.lit(P.NO_TITLE)).alias("title"), "url",
        F.coalesce(parts["block"], F.lit(P.NO_DESCRIPTION)).alias("description"),
        X.details_map(parts["rows"], text).alias("additional_details"), X.preview(text).alias("full_text"))
    details = F.col("additional_details")

    def known(name):
        return blank_to_null(F.try_element_at(details, F.lit(name))).alias(name)

    return out.select(
        "title", "url", F.coalesce(known("location"), F.lit(p.default_location)).alias("location"), "description",
        *[known(n) for n in ("salary", "experience", "company", "employment_type", "education", "skills")],
        "additional_details", "full_text", F.lit("job_detail").alias("type"), stamp.alias("date_posted"),
        stamp.alias("scraped_at"), F.lit(None).cast("string").alias("error"))


def category_records(pages: DataFrame, scraped_at: Column | str | None = None,
                     location: str = P.DEFAULT_COUNTRY) -> DataFrame:
    """Records of category pages, as they stand beside the posting records (see `page_kind`)."""
    stamp = _stamp(scraped_at)
    return pages.where(F.col("type") == "category").select(
        F.col("category_title").alias("title"), "url", F.lit(location).alias("location"),
        F.lit(P.CATEGORY_DESCRIPTION).alias("description"), "type", stamp.alias("date_posted"),
        stamp.alias("scraped_at"))
