"""Row predicates (F1, F3, F9-F16) as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from career_index.constants import (
    ATS_DOMAINS, CAREER_KEYWORDS, CAREER_PAGE_PHRASES, JOB_LINK_BLOCKED,
    JOB_LINK_TOKENS, URL_MAX_LEN,
)
from career_index.functions.text import _c, collapse_ws, let, ustrip
from career_index.functions.urls import ensure_scheme, netloc, url_path


def any_substring_re(words) -> str:
    """Regex alternation matching any of ``words`` as a plain substring."""
    return "|".join(re.escape(w) for w in words)


CAREER_KEYWORD_RE = any_substring_re(CAREER_KEYWORDS)
CAREER_PHRASE_RE = any_substring_re(CAREER_PAGE_PHRASES)
JOB_BLOCKED_RE = any_substring_re(JOB_LINK_BLOCKED)
JOB_TOKEN_RE = any_substring_re(JOB_LINK_TOKENS)
ATS_RE = any_substring_re(ATS_DOMAINS)


def is_valid_website(c) -> Column:
    """with a scheme added if missing, the host contains a dot and the URL is <= 220 chars."""
    cand = ensure_scheme(_c(c))
    host = netloc(cand)
    return (host != "") & host.contains(".") & (F.length(cand) <= URL_MAX_LEN)


def is_listed_country(c, countries) -> Column:
    """lower(strip(text)), space-padded, contains one listed country as whole words."""
    t = F.lower(ustrip(_c(c)))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    arr = F.array(*[F.lit(x) for x in countries])
    return (t != "") & F.exists(arr, lambda x: padded.contains(F.concat(F.lit(" "), x, F.lit(" "))))


def has_career_keyword(c) -> Column:
    """one of the career keywords occurs in the (already lower-cased) text."""
    return F.coalesce(_c(c).rlike(CAREER_KEYWORD_RE), F.lit(False))


def has_career_phrase(body, collapsed: bool = False) -> Column:
    """A hiring phrase occurs in the lower-cased, whitespace-collapsed body text, wherever it stands. ``collapsed``: its whitespace is so already."""
    low = F.lower(_c(body))
    return F.coalesce((low if collapsed else collapse_ws(low)).rlike(CAREER_PHRASE_RE), F.lit(False))


def is_career_page(url, title, phrase) -> Column:
    """keyword in the page title, or keyword in the URL, or a hiring phrase in the body (``phrase``: see ``has_career_phrase``)."""
    t = F.lower(ustrip(F.coalesce(_c(title), F.lit(""))))
    return has_career_keyword(t) | has_career_keyword(F.lower(_c(url))) | _c(phrase)


def is_job_link(title, url) -> Column:
    """no blocked token and at least one job token in lower(title + " " + url)."""
    return let(F.lower(F.concat(_c(title), F.lit(" "), _c(url))), lambda blob: ~blob.rlike(JOB_BLOCKED_RE) & blob.rlike(JOB_TOKEN_RE))


def is_job_domain(company_domain, url) -> Column:
    """the link host is the company host, a subdomain of it, or an applicant-tracking host."""
    cd = _c(company_domain)
    return let(F.lower(netloc(url)), lambda d: (d != "") & ((d == cd) | d.endswith(F.concat(F.lit("."), cd)) | d.rlike(ATS_RE)))


def is_related_domain(home, url) -> Column:
    """the link host equals the home host or is a subdomain of it (``www.`` not stripped)."""
    h = _c(home)
    return let(F.lower(netloc(url)), lambda d: (d != "") & ((d == h) | d.endswith(F.concat(F.lit("."), h))))


def is_challenge(html) -> Column:
    """bot-challenge interstitial."""
    low = F.lower(_c(html))
    return low.contains("just a moment") & low.contains("cf-challenge")


def is_profile_url(url, host_token: str, marker: str) -> Column:
    """host contains the directory host and the path has ``/<marker>/`` or ends in ``-company``."""
    u = _c(url)
    p = F.regexp_replace(F.lower(url_path(u)), r"^/+|/+\z", "")
    return ((u != "") & F.lower(netloc(u)).contains(host_token) & (p != "")
            & (F.concat(F.lit("/"), p, F.lit("/")).contains(f"/{marker}/") | p.endswith("-company")))


def looks_like_url(c) -> Column:
    """F16: the text starts like a URL."""
    t = F.lower(ustrip(_c(c)))
    return t.startswith("http://") | t.startswith("https://") | t.startswith("www.")
