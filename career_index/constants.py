"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES: word lists, path lists, domain lists, country lists and the source order
below are data, stated plainly in their natural order. Do not reorder them: several
operators pick "the first match" and the order is part of the result.
"""

# Source names in pipeline order; ``source_rank`` is the index in this tuple.
SOURCES = ("wikipedia", "wikipedia_global", "eu_startups", "clutch", "themanifest")

# Career keywords (substring test on lower-cased text).
CAREER_KEYWORDS = (
    "career", "careers", "jobs", "job", "join-us", "joinus", "work-with-us",
    "vacancies", "hiring", "opportunities", "workday", "talent",
)

# Fallback career paths probed on a company site, in probe order.
COMMON_CAREER_PATHS = (
    "/careers", "/career", "/jobs", "/join-us", "/vacancies", "/work-with-us",
    "/en/careers", "/en/jobs",
)

# Body phrases that mark a career page (searched in the whole text).
CAREER_PAGE_PHRASES = ("open positions", "job openings", "vacancies", "apply now")


# Applicant-tracking domains accepted as job hosts (substring test on the host).
ATS_DOMAINS = (
    "greenhouse.io", "lever.co", "workable.com", "smartrecruiters.com", "myworkdayjobs.com",
    "ashbyhq.com", "teamtailor.com", "recruitee.com", "bamboohr.com",
)

# Job-link tests on lower(title + " " + url).
JOB_LINK_BLOCKED = ("privacy", "cookie", "terms", "linkedin.com/company", "facebook.com")
JOB_LINK_TOKENS = (
    "job", "jobs", "position", "opening", "vacanc", "careers", "apply", "workday",
    "greenhouse", "lever",
)

# Header tokens used to locate list-table columns.
NAME_HEADER_TOKENS = ("company", "name", "corporation")
WEBSITE_HEADER_TOKENS = ("website", "web", "url")
COUNTRY_HEADER_TOKENS = ("country", "headquarters", "hq", "location")

# Outbound-link labels that mark a profile's company website.
WEBSITE_LINK_LABELS = ("visit website", "website", "client site")

# Directory hosts whose own links are never a company website.
DIRECTORY_HOSTS = ("clutch.co", "themanifest.com")

ENCYCLOPEDIA_HOST = "wikipedia.org"
ENCYCLOPEDIA_BASE = "https://en.wikipedia.org"
ENCYCLOPEDIA_WIKI = "https://en.wikipedia.org/wiki/"

URL_MAX_LEN = 220          # final-record URL limit
ORIGIN_MAX_LEN = 200       # free-text website limit

# European countries for the global list filter (whole-word match), in list order.
EUROPE_COUNTRIES = (
    "albania", "andorra", "armenia", "austria", "azerbaijan", "belarus", "belgium",
    "bosnia and herzegovina", "bulgaria", "croatia", "cyprus", "czech republic", "denmark",
    "estonia", "finland", "france", "georgia", "germany", "greece", "hungary", "iceland",
    "ireland", "italy", "kosovo", "latvia", "liechtenstein", "lithuania", "luxembourg",
    "malta", "moldova", "monaco", "montenegro", "netherlands", "north macedonia", "norway",
    "poland", "portugal", "romania", "san marino", "serbia", "slovakia", "slovenia", "spain",
    "sweden", "switzerland", "ukraine", "united kingdom", "vatican city",
)

# Country name (lower-cased, trimmed) -> ISO 3166-1 alpha-2, in list order.
COUNTRY_ISO = (
    ("austria", "at"), ("belgium", "be"), ("bulgaria", "bg"), ("croatia", "hr"),
    ("cyprus", "cy"), ("czechia", "cz"), ("czech republic", "cz"), ("denmark", "dk"),
    ("estonia", "ee"), ("finland", "fi"), ("france", "fr"), ("germany", "de"),
    ("greece", "gr"), ("hungary", "hu"), ("ireland", "ie"), ("italy", "it"),
    ("latvia", "lv"), ("lithuania", "lt"), ("luxembourg", "lu"), ("malta", "mt"),
    ("netherlands", "nl"), ("poland", "pl"), ("portugal", "pt"), ("romania", "ro"),
    ("slovakia", "sk"), ("slovenia", "si"), ("spain", "es"), ("sweden", "se"),
    ("switzerland", "ch"), ("turkey", "tr"), ("united kingdom", "gb"), ("russia", "ru"),
    ("norway", "no"),
)

PAGE_SIZE = 10
UNTITLED_ROLE = "Untitled role"
