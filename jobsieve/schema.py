"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PAGE = _struct(("page_id", L), ("url", S), ("html", S))

LINK = _struct(
    ("page_no", L), ("pos", L), ("url", S), ("title", S), ("parent_text", S),
    ("is_sponsored", B), ("has_date", B), ("found_date", S), ("link_class", S),
)

# Column headers of the export file, in file order, with the internal names.
EXPORT_HEADERS = {
    "title": "Job Title",
    "salary": "Salary",
    "contact": "Contact",
    "email": "Email",
    "location": "Location",
    "posting_id": "Posting ID",
    "posted_date": "Posted Date",
    "category": "Category",
    "employment_type": "Employment Type",
    "company": "Company",
    "requirements": "Requirements",
    "benefits": "Benefits",
    "description": "Description",
    "url": "Job URL",
    "scraped_at": "Scraped At",
    "is_sponsored": "Is Sponsored",
}
# Longest text written to the export file.
EXPORT_LIMITS = {"requirements": 500, "benefits": 300, "description": 1000}

POSTING_COLUMNS = tuple(EXPORT_HEADERS)
POSTING = _struct(*[(name, S) for name in POSTING_COLUMNS])
EXPORT_FILE = _struct(*[(header, S) for header in EXPORT_HEADERS.values()])

SEEN = _struct(
    ("posting_id", S), ("title", S), ("url", S),
    ("scraped_date", TS), ("first_scraped", TS), ("last_updated", TS),
)
LEDGER = _struct(("posting_id", S), ("first_scraped", TS), ("last_seen", TS), ("times_seen", L))

RUN = _struct(
    ("batch_id", L), ("started_at", TS), ("status", S), ("duration_ms", L),
    ("jobs_found", L), ("new_jobs", L), ("skipped_jobs", L), ("error", S),
)

# A captured service response: rows under `data`, counts under `summary`.
RESPONSE = _struct(
    ("success", B), ("count", L), ("scraped_at", S),
    ("data", T.ArrayType(_struct(
        ("title", S), ("url", S), ("date_posted", S), ("location", S), ("description", S),
        ("salary", S), ("experience", S), ("company", S), ("employment_type", S),
        ("education", S), ("skills", S), ("additional_details", T.MapType(S, S)),
        ("type", S), ("scraped_at", S), ("error", S),
    ))),
    ("summary", _struct(
        ("job_details", L), ("categories", L), ("with_salary", L), ("with_company", L), ("errors", L),
    )),
)
