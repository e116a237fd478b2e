r"""What a site's postings look like, as plain data that compiles to native columns.

Patterns are Java regexes. `[\h\v]` stands for any white space, look-arounds for
ASCII word boundaries and `\z` for the end of the text. A look-behind at the start of a
repeated class lets a search start only where such a run starts; the leftmost match
starts there anyway, and long runs cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. Patterns, markers and word lists that decide the results.
# ---------------------------------------------------------------------------

SALARY_PATTERNS = (
    r"(?i)Salary:?[\h\v]*(\d{3,5})",
    r"(?i)salary[\h\v]+(\d{3,5})",
    r"(?i)(\d{4})[\h\v]*(?:SR|SAR|Riyal)",
    r"(?i)(\d{3,5})[\h\v]*SAR",
)
LISTING_SALARY = r"(?i)(?<!\d)(\d+[\h\v,]*(?:sr|sar|riyal|monthly|yearly))"
LINE_SALARY_LABELLED = r"(?i)(?:salary|wage)[\h\v:]*(.+)"
LINE_SALARY_CURRENCY = r"(?i)(sr|sar)[\h\v]*([\d,]+)"
LINE_SALARY_NUMBER = r"(?i)(?<!\d)(\d+[\h\v,]*(?:sr|sar|riyal))"
FREE_SALARY_PATTERNS = (
    r"(?i)Salary:?[\h\v]*(\d+[^\n\r]*)",
    r"(?i)salary[\h\v]*(\d+[^\n\r]*)",
    r"(?i)(\d+)[\h\v]*(?:sr|sar|riyal)",
    r"(?i)fixed salary[^\n\r]*?(\d+)",
)

# The left word bound is tested behind the first digits: plain text is searched for those.
PHONE_PATTERNS = (
    r"05(?<![A-Za-z0-9_]05)\d{8}(?![A-Za-z0-9_])",
    r"01(?<![A-Za-z0-9_]01)\d{8}(?![A-Za-z0-9_])",
    r"\+966\d{9}",
    r"\d(?<![A-Za-z0-9_]\d)\d{9}(?![A-Za-z0-9_])",
)
LOOSE_PHONE = r"(?:\+966|05|01)[-\d\h\v]{8,}"
LOOSE_PHONES = (
    r"\+966[-\d\h\v]{9,}",
    r"05[-\d\h\v]{8,}",
    r"01[-\d\h\v]{8,}",
    r"0\d{9}",
)

EMAIL_ADDRESS = r"(?<![a-zA-Z0-9._%+-])([a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
EMAIL_PATTERNS = (
    r"(?i)From:[\h\v]*([^\h\v@]+@[^\h\v]+\.[^\h\v]+)",
    EMAIL_ADDRESS,
    r"(?i)Email:[\h\v]*([^\h\v@]+@[^\h\v]+)",
)

LOCATION_PATTERNS = (
    r"(?i)Region:[\h\v]*([^\n\r()]+)",
    r"(?i)Location:[\h\v]*\[([^\]]+)\]",
    r"(?i)Location:[\h\v]*([^\n\r]+)",
    r"(?i)City:[\h\v]*([^\n\r]+)",
)

POSTING_ID_PATTERNS = (
    r"(?i)Posting ID:[\h\v]*(\d+)",
    r"(?i)Post ID:[\h\v]*(\d+)",
    r"(?i)ID:[\h\v]*(\d+)",
)
URL_POSTING_ID = r"cls/(\d+)\.html"
URL_JOB_ID = r"/cls/(\d+)"

POSTED_DATE_PATTERNS = (
    r"(?i)Posted:[\h\v]*([^\n\r]+)",
    r"(?i)Date:[\h\v]*([^\n\r]+)",
    r"(\d{1,2}/\d{1,2}/\d{4})",
    r"(\d{1,2}-\d{1,2}-\d{4})",
    r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\h\v]+\d{1,2},?[\h\v]+\d{4})",
)
POSTED_FORMAT = "MMM d, yyyy, h:mm:ss a"

CATEGORY_PATTERN = r"(?i)Category:[\h\v]*([^\n\r]+)"

CONTENT_TITLE_PATTERNS = (
    r"(?i)Hiring For ([^\n\r]+)",
    r"(?i)Position: ([^\n\r]+)",
    r"(?i)Job Title: ([^\n\r]+)",
    r"(?i)Looking for ([^\n\r]+)",
)

@dataclass(frozen=True)
class Opening:
    """What opens a section, in any case: the first of the words; with endings, what stands from there to the next ending.

    `on_line`: from the first of a line's words to the next ending on that line, on the first line that has both. Else only
    the first word of the text counts: where no ending follows that one, none follows a later one.
    """
    words: tuple[str, ...]
    endings: tuple[str, ...] = ()
    on_line: bool = False


def _any_of(words: str) -> Opening:
    return Opening(tuple(words.split("|")))


def _first_on_line(opening: str, ending: str) -> Opening:
    return Opening(tuple(opening.split("|")), tuple(ending.split("|")), True)


def _first_in_text(opening: str, ending: str) -> Opening:
    return Opening(tuple(opening.split("|")), tuple(ending.split("|")))


# A section rule: its opening, words that end the section (in any case), and whether an empty line before a letter ends
# it too.
REQUIREMENTS_RULES = (
    (_any_of("Requirements:"),
     ("What We Offer", "Benefits", "For More Details", "Contact", "Salary", "Position", "Back", "Next"), True),
    (_any_of("Valid And Transferable|Experience required|Must have"),
     ("What We Offer", "Benefits", "For More Details", "Communication", "Contact"), False),
    (_any_of("Qualifications|Minimum requirements"),
     ("What We Offer", "Benefits", "For More Details"), False),
    (_first_on_line("Education|Experience", "required|needed|must"),
     ("What We Offer", "Benefits", "For More Details"), False),
)
REQUIREMENTS_HEADING = "Requirements:"
REQUIREMENTS_BULLET = "✅"
REQUIREMENTS_LENGTH = (31, 599)

BENEFITS_RULES = (
    (_any_of("What We Offer:"), ("Requirements", "For More Details", "Contact", "Back", "Next"), True),
    (_any_of("Competitive fixed salary|Company will provide|Benefits include"),
     ("Requirements", "For More Details", "Contact"), False),
    (_first_in_text("Accommodation|Housing|Medical|Insurance", "provided|included|covered"),
     ("Requirements", "For More Details", "Contact"), False),
)
BENEFITS_HEADING = "What We Offer:"
BENEFITS_BULLET = "🎁"
BENEFITS_LENGTH = (21, 499)

# Opening and ends of sections of which the first characters are shown.
CAPPED_REQUIREMENTS = (_any_of("Requirements:|Requirement:|Qualifications:|Qualification:"), ("What We Offer", "Benefits", "Contact"))
CAPPED_BENEFITS = (_any_of("What We Offer:|Benefits:|Benefit:"), ("Requirements", "Contact"))
SQUEEZED_REQUIREMENTS = (_any_of("Requirements:"), ("What We Offer", "For More Details", "Contact"))

DESCRIPTION_MARKER = "Chat on WhatsApp"
END_MARKERS = (
    "Back", "Next", "Email to a Friend", "Page View Count",
    "© 2025", "NEVER PAY ANY KIND", "Facebook", "Twitter",
)
MORE_END_MARKERS = END_MARKERS + (
    "Print", "Report", "Previous", "Following", "Search Jobs",
)
DESCRIPTION_RULES = (
    (_any_of("Hiring|We are looking|Job Details|Position"),
     ("Back", "Next", "Email to a Friend", "Page View Count", "© 2025"), False),
    (_first_in_text("Accommodation|Company will provide", "Requirements|What We Offer"),
     ("Back", "Next", "Email", "©"), False),
)
LONG_STRETCH_LENGTH = 200
LONG_STRETCH_ENDS = ("Back", "Next", "Email to a Friend", "©")
LONG_STRETCH = rf"(?i)(?:\A|(?<=\.))[^.]{{{LONG_STRETCH_LENGTH},}}(?={'|'.join(LONG_STRETCH_ENDS)}|\z)"
HEADER_END_MARKERS = ("Chat on WhatsApp", "Contact", "Phone:", "Email:")
FOOTER_START_MARKERS = ("Back", "Next", "© 2025", "Email to a Friend")

NOISE_PATTERNS = (
    r"\(adsbygoogle[^)]*\)[^;]*;",
    r"window\.__CF\$cv\$params[^}]*\}",
    r"document\.createElement[^;]*;",
    r"googletag\.cmd[^;]*;",
)
# What each of them starts with.
NOISE_OPENINGS = ("(adsbygoogle", "window.__CF$cv$params", "document.createElement", "googletag.cmd")
SHORT_HEADINGS = (
    (r"(?i)Job Details:[\h\v]*", "\n📋 Job Details:\n"),
    (r"(?i)Requirements:[\h\v]*", "\n✅ Requirements:\n"),
    (r"(?i)What We Offer:[\h\v]*", "\n🎁 What We Offer:\n"),
)
LONG_HEADINGS = (
    (r"(?i)Job Details:[\h\v]*", "\n\n📋 Job Details:\n"),
    (r"(?i)Requirements:[\h\v]*", "\n\n✅ Requirements:\n"),
    (r"(?i)What We Offer:[\h\v]*", "\n\n🎁 What We Offer:\n"),
    (r"(?i)For More Details", "\n\n📞 For More Details"),
    (r"(?i)Accommodation:", "\n🏠 Accommodation:"),
    (r"(?i)Salary:", "\n💰 Salary:"),
    (r"(?i)Contact:", "\n📱 Contact:"),
)
CONTINUED = "\n\n[...description continues...]"

CHALLENGE_PHRASES = ("verify you are human", "checking your browser")
CHALLENGE_OPENING = "Verify you are human"
CHALLENGE_TITLE = "just a moment"
MORE_CHALLENGE_PHRASES = (
    "checking your browser", "enable javascript and cookies", "cloudflare", "verify you are human",
)

EMPLOYMENT_2 = ("full-time", "part-time")
EMPLOYMENT_5 = ("full-time", "part-time", "contract", "temporary", "permanent")
EMPLOYMENT_7 = EMPLOYMENT_5 + ("internship", "freelance")
EMPLOYMENT_LOOSE = r"(full[-\h\v]?time|part[-\h\v]?time|contract|temporary|permanent)"

SKILLS = (
    "english", "arabic", "hindi", "urdu",
    "microsoft office", "excel", "word", "powerpoint", "outlook",
    "autocad", "photoshop", "illustrator", "corel draw",
    "programming", "java", "python", "javascript", "php", "sql",
    "management", "leadership", "supervision", "team lead",
    "sales", "marketing", "customer service", "communication",
    "accounting", "finance", "bookkeeping", "quickbooks",
    "driving", "driver license", "valid license",
    "mechanical", "electrical", "civil engineering", "construction",
    "medical", "nursing", "healthcare", "clinical",
)
LISTING_SKILLS = (
    "english", "arabic", "driver", "license", "experience",
    "excel", "computer", "management", "sales", "engineer",
    "mechanic", "technician", "supervisor", "assistant",
)
CITIES = ("riyadh", "jeddah", "dammam", "khobar", "jubail", "medina", "mecca", "taif", "abha")
JOB_FAMILIES = ("driver", "engineer", "manager", "sales", "mechanic", "teacher", "nurse")

# Words that open a labelled line, its pattern, and the longest value kept (exclusive).
LOCATION_LINE = (("location", "city", "area"), r"(?i)(?:location|city|area)[\h\v:]+(.+)", 50)
COMPANY_LINE = (("company", "employer", "organization"), r"(?i)(?:company|employer|organization)[\h\v:]+(.+)", 100)
EXPERIENCE_LINE = (("experience",), r"(?i)experience[\h\v:]+(.+)", 100)
EDUCATION_LINE = (("education", "qualification", "degree"), r"(?i)(?:education|qualification|degree)[\h\v:]+(.+)", 100)
SALARY_LINE_WORDS = ("salary", "wage", "sr", "sar")
CONTACT_LINE_WORDS = ("contact", "phone", "mobile", "email")
LOWER_LABELS = ("salary", "experience", "location", "company", "education", "skills")

DEFAULT_COUNTRY = "Saudi Arabia"
NO_TITLE = "No title found"
NO_DESCRIPTION = "No description found"
# Sentences of the listing report.
REPORT_SPONSORED = ('Working correctly - jobs ending with "Sponsored" detected', "No sponsored jobs found")
REPORT_REGULAR = ("Working correctly - jobs with timestamps detected", "No regular jobs found")
REPORT_ACCURACY = ((95, "Excellent"), (85, "Good"), (None, "Needs improvement"))
REPORT_UNKNOWN = (" jobs need pattern review", "All jobs classified successfully")

CATEGORY_TITLE = "Job Category: "
CATEGORY_DESCRIPTION = "This is a job category page with multiple listings"


@dataclass(frozen=True)
class ExtractionProfile:
    """Rules of one extraction variant. `own_domain` is the listing site's own host name."""

    own_domain: str
    kind: str = "primary"
    salary_patterns: tuple[str, ...] = SALARY_PATTERNS
    phone_patterns: tuple[str, ...] = PHONE_PATTERNS
    email_patterns: tuple[str, ...] = EMAIL_PATTERNS
    location_patterns: tuple[str, ...] = LOCATION_PATTERNS
    posting_id_patterns: tuple[str, ...] = POSTING_ID_PATTERNS
    posted_patterns: tuple[str, ...] = POSTED_DATE_PATTERNS
    employment_words: tuple[str, ...] = ()
    skills: tuple[str, ...] = SKILLS
    cities: tuple[str, ...] = CITIES
    marker: str = DESCRIPTION_MARKER
    # 16 skips exactly the marker; 20 also drops the four characters after it.
    marker_skip: int = 16
    end_markers: tuple[str, ...] = END_MARKERS
    default_location: str = DEFAULT_COUNTRY


def primary_profile(own_domain: str, **changes) -> ExtractionProfile:
    """The short posting record: no category, employment type or sections."""
    return ExtractionProfile(own_domain=own_domain, **changes)


def full_profile(own_domain: str, **changes) -> ExtractionProfile:
    """All sixteen columns, with category, employment type, requirements and benefits."""
    rules = dict(
        kind="full",
        salary_patterns=SALARY_PATTERNS[:3],
        phone_patterns=PHONE_PATTERNS[:3],
        location_patterns=LOCATION_PATTERNS[:3],
        posting_id_patterns=POSTING_ID_PATTERNS[:1],
        posted_patterns=POSTED_DATE_PATTERNS[:1],
        employment_words=EMPLOYMENT_2,
        end_markers=MORE_END_MARKERS,
    )
    return ExtractionProfile(own_domain=own_domain, **{**rules, **changes})


def skills_profile(own_domain: str, **changes) -> ExtractionProfile:
    """Line-oriented record with NULL for missing values and a list of skills."""
    return ExtractionProfile(own_domain=own_domain, **{"kind": "skills", "employment_words": EMPLOYMENT_7, **changes})


def keyed_profile(own_domain: str, **changes) -> ExtractionProfile:
    """Record with an open map of `key: value` details."""
    return ExtractionProfile(own_domain=own_domain, **{"kind": "keyed", **changes})
