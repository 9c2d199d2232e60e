"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator, and the
matching DuckDB oracle SQL. Every query reads the driver tables (or frames Spark derives from
them) in full. Array columns are exported as ``jobs_text`` strings so both engines compare."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from career_index.functions import predicates as P
from career_index.functions.text import clean_cell, fold, name_key, ustrip
from career_index.functions.urls import (
    domain_key, ensure_scheme, final_url, netloc, normalize_url,
)
from career_index.operators import dedupe as D
from career_index.operators import query as Q
from career_index.operators.ranking import with_rank
from career_index.operators.resolve import final_records
from career_index.operators import resolve as R
from career_index.plans import api
from career_index.plans import oracle as O
from career_index.sources.fixtures import candidates_with_ord, raw_candidates, served_companies
from career_index.session import ensure_checkpoint_dir
from career_index.sources.tables import table
from career_index.storage import stored
from career_index.constants import ATS_DOMAINS, CAREER_KEYWORDS, EUROPE_COUNTRIES, JOB_LINK_BLOCKED, JOB_LINK_TOKENS
from career_index.functions.scoring import right_wins
from career_index.functions.urls import apply_url as api_apply_url
from career_index.functions.text import contains_folded as api_contains_folded
from career_index.functions.urls import canonical_origin as api_canonical_origin
from career_index.functions.urls import page_url as api_page_url
from career_index.operators.records import company_record as api_company_record
from career_index.operators.resolve import score as api_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

COMPANY_OUT = ("ord", "name", "website", "career_page_url", "country_of_origin", "source")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def jobs_text(c="jobs") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(col, lambda j: F.concat(j["title"], F.lit(" | "), j["url"])), " ; ")


def company_out(df: DataFrame, *extra) -> DataFrame:
    return df.select(*COMPANY_OUT, jobs_text().alias("jobs_text"), *extra)


CO_SQL = "ord, name, website, career_page_url, country_of_origin, source, " + O.jobs_text("jobs") + " AS jobs_text"

# ---------------------------------------------------------------- scalar projections

register("p1_normalize_url", f"SELECT page_id, url, {O.normalize_url('url')} AS normalized FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", "url", normalize_url("url").alias("normalized")))

register("p2_final_url",
         f"SELECT source_rank, seq, website, {O.final_url('website')} AS website_final, "
         f"{O.final_url('career_page_url')} AS career_final FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select(
        "source_rank", "seq", "website", final_url("website").alias("website_final"),
        final_url("career_page_url").alias("career_final")))

register("p3_domain_key",
         f"SELECT source_rank, seq, {O.domain_key(O.final_url('website'))} AS domain_key, "
         f"{O.domain_key('career_page_url')} AS career_domain_key FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select(
        "source_rank", "seq", domain_key(final_url("website")).alias("domain_key"),
        domain_key("career_page_url").alias("career_domain_key")))

register("p6_name_key", f"SELECT source_rank, seq, {O.name_key('name')} AS name_key FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select("source_rank", "seq", name_key("name").alias("name_key")))

_CELL_SQL = "concat(' ', s_name, '[', CAST(s_suppkey % 3 AS STRING), ']  Group [note]\t', CAST(s_nationkey AS STRING), ' ')"
register("p7_clean_cell", f"SELECT s_suppkey, {O.clean_cell(_CELL_SQL)} AS cell FROM supplier")(
    lambda spark, d: table(spark, d, "supplier").select("s_suppkey", clean_cell(F.expr(_CELL_SQL)).alias("cell")))

register("p9_netloc", f"SELECT page_id, lower({O.netloc('url')}) AS netloc FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", F.lower(netloc("url")).alias("netloc")))

register("p15_ensure_scheme",
         f"SELECT source_rank, seq, {O.ensure_scheme('website')} AS website_https FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select("source_rank", "seq",
                                                     ensure_scheme("website").alias("website_https")))

# ---------------------------------------------------------------- predicates and gates


def _f1_sql() -> str:
    w = O.strip("website")
    u = O.ensure_scheme(w)
    return (f"SELECT source_rank, seq, ({w} <> '' AND {O.netloc(u)} <> '' AND contains({O.netloc(u)}, '.') "
            f"AND length({u}) <= 220) AS valid FROM {O.raw_candidates()}")


register("f1_valid_website", _f1_sql())(
    lambda spark, d: raw_candidates(spark, d).select(
        "source_rank", "seq", ((ustrip("website") != "") & P.is_valid_website(ustrip("website"))).alias("valid")))

register("f2_final_records", f"WITH {O.final_records_cte()} SELECT {CO_SQL} FROM fr")(
    lambda spark, d: company_out(final_records(candidates_with_ord(spark, d))))

register("w1_first_wins",
         f"SELECT source_rank, seq, name, website FROM (SELECT *, row_number() OVER (PARTITION BY "
         f"lower({O.strip('name')}), lower({O.strip('website')}) ORDER BY source_rank, seq) AS rn "
         f"FROM {O.raw_candidates()}) WHERE rn = 1")(
    lambda spark, d: D.dedupe_candidates(raw_candidates(spark, d)).select("source_rank", "seq", "name", "website"))

register("w5_clean_jobs", f"WITH {O.final_records_cte()} SELECT seq, {O.jobs_text('jobs')} AS jobs_text FROM fr")(
    lambda spark, d: final_records(candidates_with_ord(spark, d), keep=("seq",)).select(
        "seq", jobs_text(D.clean_jobs("jobs")).alias("jobs_text")))

# One link per supplier: its text, its URL and the site it was found on.
_LINK_COLUMNS = (
    ("host", "concat(CASE WHEN s_suppkey % 5 = 0 THEN 'www.' ELSE '' END, 's', CAST(s_suppkey % 50 AS STRING), '.example.com')"),
    ("title", "CASE s_suppkey % 7 WHEN 0 THEN 'Open position' WHEN 1 THEN 'Privacy of applicants' WHEN 2 THEN 'News' WHEN 3 THEN 'JOBS and careers' "
              "WHEN 4 THEN 'Talent pool' WHEN 5 THEN ' Apply now ' ELSE '' END"),
    ("url", "concat('https://', CASE s_suppkey % 6 WHEN 0 THEN concat('s', CAST(s_suppkey % 50 AS STRING), '.example.com') WHEN 1 THEN concat('WWW.s', "
            "CAST(s_suppkey % 50 AS STRING), '.example.com:80') WHEN 2 THEN concat('jobs.s', CAST(s_suppkey % 50 AS STRING), '.example.com') "
            "WHEN 3 THEN 'boards.greenhouse.io' WHEN 4 THEN 'clutch.co' ELSE 'other.example.org' END, CASE s_suppkey % 8 WHEN 0 THEN '/jobs/1' "
            "WHEN 1 THEN '/profile/acme' WHEN 2 THEN '/x/acme-company/' WHEN 3 THEN '' WHEN 4 THEN '/cookie-jobs' WHEN 5 THEN '/company/profile' "
            "WHEN 6 THEN '/vacancies?x=1' ELSE '/about' END)"),
    ("phrase", "s_suppkey % 11 = 0"),
    ("html", "concat(CASE WHEN s_suppkey % 2 = 0 THEN '<p>Just A Moment</p>' ELSE '<p>A moment</p>' END, CASE WHEN s_suppkey % 3 = 0 THEN '<i id=CF-challenge>' ELSE '' END)"),
)


def _links(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey", *[f"{e} AS {a}" for a, e in _LINK_COLUMNS])


_LINKS_SQL = "(SELECT s_suppkey, " + ", ".join(f"{e} AS {a}" for a, e in _LINK_COLUMNS) + " FROM supplier)"
_KEYWORDS_SQL = "[" + ", ".join(f"'{w}'" for w in CAREER_KEYWORDS) + "]"


def _any_sql(text: str, words: str) -> str:
    return f"len(list_filter({words}, lambda w: contains({text}, w))) > 0"


def _list_sql(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_HOST_SQL = f"lower({O.netloc('url')})"
register("f9_career_keyword", f"SELECT s_suppkey, {_any_sql('lower(title)', _KEYWORDS_SQL)} AS hit FROM {_LINKS_SQL}")(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.has_career_keyword(F.lower("title")).alias("hit")))
register("f10_career_page", (
    f"SELECT s_suppkey, {_any_sql('lower(title)', _KEYWORDS_SQL)} OR {_any_sql('lower(url)', _KEYWORDS_SQL)} OR phrase AS hit FROM {_LINKS_SQL}"))(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_career_page("url", "title", "phrase").alias("hit")))
_BLOB_SQL = "lower(title || ' ' || url)"
register("f11_job_link", (
    f"SELECT s_suppkey, NOT {_any_sql(_BLOB_SQL, _list_sql(JOB_LINK_BLOCKED))} AND {_any_sql(_BLOB_SQL, _list_sql(JOB_LINK_TOKENS))} AS hit FROM {_LINKS_SQL}"))(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_job_link("title", "url").alias("hit")))
register("f12_job_domain", (
    f"SELECT s_suppkey, {_HOST_SQL} = host OR ends_with({_HOST_SQL}, '.' || host) OR {_any_sql(_HOST_SQL, _list_sql(ATS_DOMAINS))} AS hit FROM {_LINKS_SQL}"))(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_job_domain("host", F.col("url")).alias("hit")))
register("f13_related_domain", f"SELECT s_suppkey, {_HOST_SQL} = host OR ends_with({_HOST_SQL}, '.' || host) AS hit FROM {_LINKS_SQL}")(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_related_domain("host", F.col("url")).alias("hit")))
register("f14_challenge", f"SELECT s_suppkey, contains(lower(html), 'just a moment') AND contains(lower(html), 'cf-challenge') AS hit FROM {_LINKS_SQL}")(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_challenge("html").alias("hit")))
register("f15_profile_url", (
    f"SELECT s_suppkey, contains({_HOST_SQL}, 'clutch.co') AND (regexp_matches(url, '^https://[^/]*/profile/') OR regexp_matches(url, '-company/?$')) "
    f"AS hit FROM {_LINKS_SQL}"))(
    lambda spark, d: _links(spark, d).select("s_suppkey", P.is_profile_url(F.col("url"), "clutch.co", "profile").alias("hit")))

# ---------------------------------------------------------------- served-table queries


def served(spark, d):
    return served_companies(spark, d)


def _jobs_sql(where: str, key: str, desc: bool) -> str:
    k = f"{key} DESC" if desc else key
    return O.with_served(
        "SELECT company_name, company_website, country_of_origin, source, career_page_url, title, url, "
        f"row_number() OVER (ORDER BY {k}, lower(company_name), ord, pos) AS rank FROM ("
        "SELECT name AS company_name, website AS company_website, country_of_origin, source, career_page_url, "
        f"{O.strip('j.title')} AS title, {O.strip('j.url')} AS url, ord, pos FROM ("
        "SELECT *, unnest(jobs) AS j, generate_subscripts(jobs, 1) AS pos FROM served WHERE len(jobs) > 0)) "
        f"WHERE title <> '' AND url <> '' {where}")


register("q2_jobs_urgent_by_title",
         _jobs_sql(f"AND (contains({O.fold('title')}, 'urgent') OR contains({O.fold('url')}, 'urgent'))",
                   O.fold("title"), False))(
    lambda spark, d: api.jobs(served(spark, d), query="urgent", sort_by="title").select(*Q.JOB_ROW_COLUMNS, "rank"))

register("o3_sort_jobs_source_desc",
         _jobs_sql(f"AND contains({O.fold('country_of_origin')}, 'an')", O.fold("source"), True))(
    lambda spark, d: api.jobs(served(spark, d), country="AN", sort_by="source", sort_order="desc").select(
        *Q.JOB_ROW_COLUMNS, "rank"))

register("n1_job_rows", _jobs_sql("", O.fold("company_name"), False))(
    lambda spark, d: api.jobs(served(spark, d)).select(*Q.JOB_ROW_COLUMNS, "rank"))

register("a3_stats", O.with_served(
    "SELECT count(*) AS companies_count, CAST(coalesce(sum(CASE WHEN len(jobs) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) "
    "AS companies_with_jobs_count, CAST(coalesce(sum(len(jobs)), 0) AS BIGINT) AS total_jobs_count FROM served"))(
    lambda spark, d: api.stats(served(spark, d)))

register("a5_jobs_count", O.with_served("SELECT ord, len(jobs) AS jobs_count FROM served"))(
    lambda spark, d: served(spark, d).select("ord", Q.jobs_count().alias("jobs_count")))

register("o1_base_order", O.with_served(f"SELECT {CO_SQL}, row_number() OVER (ORDER BY lower(name), ord) AS rank FROM served"))(
    lambda spark, d: company_out(with_rank(served(spark, d), *Q.base_order()), "rank"))

register("q1_companies_jobs_count_desc", O.with_served(
    f"SELECT {CO_SQL}, len(jobs) AS jobs_count, row_number() OVER (ORDER BY len(jobs) DESC, lower(name), ord) AS rank "
    f"FROM served WHERE contains({O.fold('country_of_origin')}, 'united') AND len(jobs) > 0"))(
    lambda spark, d: company_out(api.companies(served(spark, d), country="United", has_jobs=True,
                                               sort_by="jobs_count", sort_order="desc"),
                                 Q.jobs_count().alias("jobs_count"), "rank"))

register("o2_sort_companies_country_desc", O.with_served(
    f"SELECT {CO_SQL}, row_number() OVER (ORDER BY {O.fold('country_of_origin')} DESC, lower(name), ord) AS rank "
    "FROM served"))(
    lambda spark, d: company_out(api.companies(served(spark, d), sort_by="country", sort_order="desc"), "rank"))

register("f4_filter_companies", O.with_served(
    f"SELECT {CO_SQL} FROM served WHERE contains({O.fold('country_of_origin')}, 'kingdom') "
    f"AND contains({O.fold('source')}, 'wiki') AND contains({O.fold('name')}, 'company 1')"))(
    lambda spark, d: company_out(Q.filter_companies(served(spark, d), "KINGDOM", "Wiki", "company 1")))

register("f5_has_jobs_false", O.with_served(f"SELECT {CO_SQL} FROM served WHERE len(jobs) = 0"))(
    lambda spark, d: company_out(Q.filter_has_jobs(served(spark, d), False)))

register("f6_jobs_query", O.with_served(
    f"SELECT {CO_SQL} FROM served WHERE len(list_filter(jobs, lambda j: contains({O.fold('j.title')}, 'high') "
    f"OR contains({O.fold('j.url')}, 'high'))) > 0"))(
    lambda spark, d: company_out(Q.filter_jobs_query(served(spark, d), "HIGH")))

# ---------------------------------------------------------------- feed-side queries

register("f7_filter_facets", O.with_served(
    f"SELECT {CO_SQL} FROM served WHERE country_of_origin IN ('France', 'Germany', 'Unknown') "
    "AND source IN ('wikipedia', 'clutch', 'themanifest') AND len(jobs) > 0"))(
    lambda spark, d: company_out(Q.filter_facets(served(spark, d), ["France", "Germany", "Unknown"],
                                                 ["wikipedia", "clutch", "themanifest"], [], ["with_jobs"])))

register("f8_filter_text", O.with_served(
    f"SELECT {CO_SQL} FROM served WHERE contains(lower(name), 'kingdom') OR contains(lower(country_of_origin), 'kingdom') "
    "OR contains(lower(source), 'kingdom') OR len(list_filter(jobs, lambda j: contains(lower(j.title), 'kingdom') "
    "OR contains(lower(j.url), 'kingdom'))) > 0"))(
    lambda spark, d: company_out(Q.filter_text(served(spark, d), "  KINGDOM ")))

_CARDS_SQL = ("SELECT name || '::' || CASE WHEN j.url <> '' THEN j.url ELSE j.title END AS key, "
              "CASE WHEN j.title <> '' THEN j.title ELSE 'Untitled role' END AS title, j.url AS url, "
              "name AS company_name, website AS company_website, career_page_url, country_of_origin, source, ord, pos "
              "FROM (SELECT *, unnest(jobs) AS j, generate_subscripts(jobs, 1) - 1 AS pos FROM served WHERE len(jobs) > 0)")
register("n2_job_cards", O.with_served(f"SELECT * FROM ({_CARDS_SQL})"))(
    lambda spark, d: Q.job_cards(served(spark, d)))

register("p14_apply_url", O.with_served(
    f"SELECT key, ord, pos, CASE WHEN url IS NULL OR url = '' THEN career_page_url ELSE url END AS apply_url FROM ({_CARDS_SQL})"))(
    lambda spark, d: Q.job_cards(served(spark, d)).select(
        "key", "ord", "pos", api_apply_url("url", "career_page_url").alias("apply_url")))

_ISO_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in Q.COUNTRY_ISO)
register("j6_country_iso", O.with_served(
    f"SELECT s.ord, s.country_of_origin, coalesce(i.iso, '') AS country_iso FROM served s LEFT JOIN "
    f"(VALUES {_ISO_VALUES}) i(country_key, iso) ON lower({O.strip('s.country_of_origin')}) = i.country_key"))(
    lambda spark, d: Q.with_country_iso(served(spark, d)).select("ord", "country_of_origin", "country_iso"))

register("a4_facet_values_country", O.with_served(
    f"SELECT value, row_number() OVER (ORDER BY {O.locale_key('value')}, value) AS rank FROM "
    "(SELECT DISTINCT country_of_origin AS value FROM served WHERE country_of_origin <> '')"))(
    lambda spark, d: Q.facet_values(served(spark, d), "country_of_origin"))

register("a4_facet_values_company_find", O.with_served(
    f"SELECT value, row_number() OVER (ORDER BY {O.locale_key('value')}, value) AS rank FROM "
    "(SELECT DISTINCT name AS value FROM served WHERE name <> '' AND contains(lower(name), 'company 2'))"))(
    lambda spark, d: Q.facet_values(served(spark, d), "name", find=" Company 2"))

register("o4_sort_display_company_desc", O.with_served(
    f"SELECT {CO_SQL}, row_number() OVER (ORDER BY {O.locale_key('name', True)}, lower(name) DESC, ord DESC) AS rank "
    "FROM served"))(
    lambda spark, d: company_out(Q.sort_display(served(spark, d), "company", "desc"), "rank"))

register("o4_sort_display_jobs_count_asc", O.with_served(
    f"SELECT {CO_SQL}, row_number() OVER (ORDER BY len(jobs), lower(name), ord) AS rank FROM served"))(
    lambda spark, d: company_out(Q.sort_display(served(spark, d), "jobs_count", "asc"), "rank"))


def _feed_sql(page_no: int) -> str:
    vis = (f"SELECT * FROM served WHERE source IN ('wikipedia', 'eu_startups', 'themanifest') AND len(jobs) > 0 "
           "AND (contains(lower(name), '1') OR contains(lower(country_of_origin), '1') OR contains(lower(source), '1') "
           "OR len(list_filter(jobs, lambda j: contains(lower(j.title), '1') OR contains(lower(j.url), '1'))) > 0)")
    cards = _CARDS_SQL.replace("FROM served WHERE len(jobs) > 0", f"FROM ({vis}) WHERE len(jobs) > 0")
    ranked = (f"SELECT c.*, coalesce(i.iso, '') AS country_iso, CASE WHEN url = '' THEN career_page_url ELSE url END "
              f"AS apply_url, row_number() OVER (ORDER BY {O.locale_key('country_of_origin', True)}, "
              "lower(company_name) DESC, ord DESC, pos) AS rank, count(*) OVER () AS n "
              f"FROM ({cards}) c LEFT JOIN (VALUES {_ISO_VALUES}) i(country_key, iso) "
              f"ON lower({O.strip('c.country_of_origin')}) = i.country_key")
    pg = f"least(greatest(1, {page_no}), greatest(1, CAST(ceil(n / 10.0) AS BIGINT)))"
    return O.with_served(
        f"SELECT key, title, url, company_name, company_website, career_page_url, country_of_origin, source, ord, pos, "
        f"country_iso, apply_url, rank, CAST({pg} AS INT) AS page FROM ({ranked}) WHERE rank > ({pg} - 1) * 10 "
        f"AND rank <= {pg} * 10")


def _feed(page_no):
    def run(spark, d):
        return api.feed(stored(served(spark, d), "served"), sources=["wikipedia", "eu_startups", "themanifest"], job_boxes=["with_jobs"],
                        text=" 1", sort_by="country", sort_order="desc", page_number=page_no)
    return run


register("q5_feed_page_3", _feed_sql(3))(_feed(3))
register("o5_page_beyond_end", _feed_sql(10_000))(_feed(10_000))

# ---------------------------------------------------------------- more scalar operators

_FREE_TEXT = "concat('Website: ', website, '). Call us')"
register("p5_canonical_origin",
         f"SELECT source_rank, seq, {O.canonical_origin(_FREE_TEXT)} AS origin FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select("source_rank", "seq",
                                                     api_canonical_origin(F.expr(_FREE_TEXT)).alias("origin")))

register("p8_contains_folded", O.with_served(
    f"SELECT ord, contains({O.fold('name')}, {O.fold(chr(39) + 'COMPANY 1' + chr(39))}) AS hit FROM served"))(
    lambda spark, d: served(spark, d).select("ord", api_contains_folded("name", "COMPANY 1").alias("hit")))

register("p10_page_url",
         "SELECT s_suppkey, 'https://en.wikipedia.org/wiki/' || replace(url_encode(replace("
         + O.strip("concat(s_name, ' & Co/ ', CAST(s_nationkey AS STRING))") + ", ' ', '_')), '%2F', '/') AS page_url FROM supplier")(
    lambda spark, d: table(spark, d, "supplier").select(
        "s_suppkey", api_page_url(F.concat("s_name", F.lit(" & Co/ "), F.col("s_nationkey").cast("string"))).alias("page_url")))

register("p11_company_record",
         f"SELECT source_rank, seq, {O.strip('name')} AS name, {O.normalize_url('website')} AS website, "
         f"{O.normalize_url('career_page_url')} AS career_page_url, {O.strip('country_of_origin')} AS country_of_origin, "
         f"'wikipedia' AS source FROM {O.raw_candidates()}")(
    lambda spark, d: api_company_record(raw_candidates(spark, d), "wikipedia", keep=("source_rank", "seq")))

_EU_SQL = ", ".join(f"'{c}'" for c in EUROPE_COUNTRIES)
register("f3_listed_country",
         f"SELECT source_rank, seq, ({O.strip('lower(country_of_origin)')} <> '' AND len(list_filter([{_EU_SQL}], "
         f"lambda c: contains(' ' || {O.strip('lower(country_of_origin)')} || ' ', ' ' || c || ' '))) > 0) AS european "
         f"FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select(
        "source_rank", "seq", P.is_listed_country("country_of_origin", EUROPE_COUNTRIES).alias("european")))

register("f16_looks_like_url",
         f"SELECT source_rank, seq, (starts_with(lower({O.strip('website')}), 'http://') OR starts_with(lower({O.strip('website')}), "
         f"'https://') OR starts_with(lower({O.strip('website')}), 'www.')) AS url_like FROM {O.raw_candidates()}")(
    lambda spark, d: raw_candidates(spark, d).select("source_rank", "seq", P.looks_like_url("website").alias("url_like")))

_SCORE_SQL = ("(2 * (name <> '')::INT + 2 * (website <> '')::INT + 3 * (career_page_url <> '')::INT "
              "+ (country_of_origin <> '' AND lower(country_of_origin) <> 'unknown')::INT "
              "+ (source <> '' AND lower(source) <> 'unknown')::INT + (len(jobs) > 0)::INT)")
register("w6_completeness", f"WITH {O.final_records_cte()} SELECT ord, {_SCORE_SQL} AS score FROM fr")(
    lambda spark, d: api_score(final_records(candidates_with_ord(spark, d))).select("ord", "score"))

register("w7_prefer", (
    f"WITH {O.served_cte()}, sc AS (SELECT *, {_SCORE_SQL} AS score, {O.domain_key('website')} AS dk FROM fr), "
    f"fst AS (SELECT *, {_SCORE_SQL} AS score, {O.domain_key('website')} AS dk FROM served) "
    "SELECT r.ord, l.ord AS first_ord, (r.score > l.score OR (lower(l.country_of_origin) = 'unknown' AND "
    "lower(r.country_of_origin) <> 'unknown') OR length(r.career_page_url) < length(l.career_page_url)) AS right_wins "
    "FROM sc r JOIN fst l ON r.dk = l.dk"))(
    lambda spark, d: api_prefer_vs_first(spark, d))


def api_prefer_vs_first(spark, d):
    """W7 of every final record against the first record of its domain."""
    fr = api_score(final_records(candidates_with_ord(spark, d))).withColumn("dk", domain_key("website"))
    first = api_score(served(spark, d)).withColumn("dk", domain_key("website"))
    l = first.select("dk", F.col("ord").alias("first_ord"), F.col("score").alias("l_score"),
                     F.col("country_of_origin").alias("l_country"), F.col("career_page_url").alias("l_career"))
    j = fr.join(l, "dk")
    return j.select("ord", "first_ord", right_wins(F.col("l_score"), F.col("l_country"), F.col("l_career"),
                                                   F.col("score"), F.col("country_of_origin"),
                                                   F.col("career_page_url")).alias("right_wins"))

# ---------------------------------------------------------------- unions, greedy dedupe, resolution

register("u1_union_sources",
         f"SELECT source_rank, seq, source, name FROM {O.raw_candidates()}")(
    lambda spark, d: D.union_sources({
        s: raw_candidates(spark, d).where(F.col("source") == s).drop("source_rank") for s in D.SOURCES
    }).select("source_rank", "seq", "source", "name"))

register("u2_union_lists", O.with_served(
    "SELECT 0 AS list_rank, ord, name FROM served UNION ALL SELECT 1, ord, name FROM fr"))(
    lambda spark, d: D.union_lists(served(spark, d), final_records(candidates_with_ord(spark, d))).select("list_rank", "ord", "name"))


def _w2_sql() -> str:
    kb = O.normalize_url("website")
    return (
        f"WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY source_rank, seq) AS i, source_rank, seq, "
        f"{O.name_key('name')} AS ka, {kb} AS kb FROM {O.raw_candidates()}), "
        "st(i, names, webs, ok) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false "
        "UNION ALL SELECT r.i, "
        "CASE WHEN NOT (list_contains(st.names, r.ka) OR (r.kb <> '' AND list_contains(st.webs, r.kb))) "
        "THEN list_append(st.names, r.ka) ELSE st.names END, "
        "CASE WHEN NOT (list_contains(st.names, r.ka) OR (r.kb <> '' AND list_contains(st.webs, r.kb))) AND r.kb <> '' "
        "THEN list_append(st.webs, r.kb) ELSE st.webs END, "
        "NOT (list_contains(st.names, r.ka) OR (r.kb <> '' AND list_contains(st.webs, r.kb))) "
        "FROM st JOIN r ON r.i = st.i + 1) "
        "SELECT r.source_rank, r.seq FROM st JOIN r ON r.i = st.i WHERE st.ok")


register("w2_greedy_dedupe", _w2_sql())(
    lambda spark, d: D.greedy_dedupe(raw_candidates(spark, d), name_key("name"), normalize_url("website"),
                                     ["source_rank", "seq"]).select("source_rank", "seq"))


def _w8_domain_sql() -> str:
    champ = ("list_reduce(list({'ord': ord, 'score': score, 'country': country_of_origin, 'career': career_page_url} "
             "ORDER BY ord), lambda c, r: CASE WHEN r.score > c.score OR (lower(c.country) = 'unknown' AND "
             "lower(r.country) <> 'unknown') OR length(r.career) < length(c.career) THEN r ELSE c END).ord")
    return (
        f"WITH {O.final_records_cte()}, sc AS (SELECT *, {_SCORE_SQL} AS score, {O.domain_key('website')} AS dk FROM fr), "
        f"g AS (SELECT min(ord) AS slot, {champ} AS rec FROM sc WHERE dk <> '' GROUP BY dk "
        "UNION ALL SELECT ord AS slot, ord AS rec FROM sc WHERE dk = '') "
        f"SELECT g.slot AS ord, source_rank, seq, name, website, career_page_url, country_of_origin, source, "
        f"{O.jobs_text('jobs')} AS jobs_text FROM g JOIN fr ON fr.ord = g.rec")


register("w8_resolve_domain_only", _w8_domain_sql())(
    lambda spark, d: R.resolve_domain_only(final_records(candidates_with_ord(spark, d), keep=("ord", "source_rank", "seq")))
    .select("ord", "source_rank", "seq", "name", "website", "career_page_url", "country_of_origin", "source",
            jobs_text().alias("jobs_text")))

register("q7_resolve", O.resolved_sql())(
    lambda spark, d: company_out(with_rank(R.resolve_fold(final_records(candidates_with_ord(spark, d))),
                                           *Q.base_order()), "rank"))

# ---------------------------------------------------------------- extraction over the page table
from career_index.operators import extract as X  # noqa: E402

register("x1_links", O.links_sql())(lambda spark, d: X.links(table(spark, d, "pages")))

register("x2_page_text", O.page_text_sql())(lambda spark, d: X.page_text(table(spark, d, "pages")))

register("x3_career_links", O.CAREER_LINKS_SQL)(lambda spark, d: X.career_links(S.company_sites(spark, d)))

# ---------------------------------------------------------------- crawl, enrichment, directory, health
from career_index.operators import directory as DIR  # noqa: E402
from career_index.operators import enrich as EN  # noqa: E402
from career_index.operators import health as H  # noqa: E402
from career_index.plans import build as B  # noqa: E402
from career_index.sources import sites as S  # noqa: E402
from career_index.sources import snapshot as SNAP  # noqa: E402


def _ckpt(df):
    return stored(df, "crawl")


register("s5_fetch", (
    f"SELECT r.page_id AS req_id, p.page_id, length(p.html) AS html_len FROM pages r JOIN "
    f"(SELECT {O.normalize_url('url')} AS key, min(page_id) AS page_id FROM pages GROUP BY 1) k "
    f"ON {O.normalize_url(chr(39) + '' + chr(39) + ' || r.url || ' + chr(39) + '#x' + chr(39))} = k.key "
    "JOIN pages p ON p.page_id = k.page_id"))(
    lambda spark, d: EN.fetch(table(spark, d, "pages").select(F.col("page_id").alias("req_id"),
                                                              F.concat("url", F.lit("#x")).alias("url")),
                              table(spark, d, "pages")).join(
        table(spark, d, "pages").select("page_id", F.length("html").alias("html_len")), "page_id")
    .select("req_id", "page_id", "html_len"))

register("a1_source_counts", (
    f"SELECT CASE WHEN {O.strip('source')} = '' THEN 'unknown' ELSE {O.strip('source')} END AS source, count(*) AS count "
    f"FROM {O.raw_candidates()} GROUP BY 1"))(
    lambda spark, d: H.source_counts(raw_candidates(spark, d)))


def _robots(spark, d):
    """Rules for every page host: '*' blocks /fr/ then allows /; our agent is blocked from /en/ on blog hosts."""
    hosts = table(spark, d, "pages").select(netloc("url").alias("domain")).distinct()
    star = hosts.select("domain", F.lit("*").alias("agent"), F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit(False).alias("allow"), F.lit("/fr/").alias("prefix")),
        F.struct(F.lit(1).alias("ord"), F.lit(True).alias("allow"), F.lit("/").alias("prefix")))).alias("r"))
    own = hosts.where(F.col("domain").startswith("blog.")).select(
        "domain", F.lit("careerindex").alias("agent"), F.struct(F.lit(2).alias("ord"), F.lit(False).alias("allow"),
                                                               F.lit("/en/").alias("prefix")).alias("r"))
    return star.unionByName(own).select("domain", "agent", "r.ord", "r.allow", "r.prefix")


register("s6_allow_urls", O.ALLOWED_SQL)(
    lambda spark, d: EN.allow_urls(table(spark, d, "pages").select("page_id", "url"), _robots(spark, d),
                                   "CareerIndex/1.0").select("page_id", "url"))

register("x4_list_rows", O.list_rows_sql())(lambda spark, d: X.list_rows(S.list_pages(spark, d, "wikipedia")))
register("x7_infobox_website", O.INFOBOX_SQL)(lambda spark, d: X.infobox_website(S.detail_pages(spark, d)))
register("x8_category_urls", O.CATEGORY_SQL)(lambda spark, d: X.category_urls(S.directory_pages(spark, d), S.DIRECTORY_ROOT))
register("x9_listing_urls", O.LISTING_URLS_SQL)(lambda spark, d: X.listing_urls(S.directory_pages(spark, d), S.DIRECTORY_ROOT)
                            .select("page_id", "url", F.col("pos.block_pos").alias("block_pos")))
register("x10_listing_records", O.LISTING_SQL)(lambda spark, d: X.listing_records(
    S.directory_pages(spark, d).where(F.col("url").contains("/listing/"))))
register("x11_profile_urls", O.PROFILE_URLS_SQL)(lambda spark, d: X.profile_urls(
    S.profile_pages(spark, d, "clutch").where(F.col("url").contains("/list/")), "clutch.co", "profile")
    .select("page_id", "stage", "url"))
register("x12_profile_records", O.PROFILE_SQL)(lambda spark, d: X.profile_records(
    S.profile_pages(spark, d, "themanifest").where(F.col("url").contains("/company/")), "themanifest"))
register("x13_json_ld", O.JSON_LD_SQL)(lambda spark, d: X.json_ld(S.company_sites(spark, d)).select(
    "page_id", "script_pos", F.length("raw").alias("raw_len")))
register("x14_json_ld_country", O.LD_COUNTRY_SQL)(lambda spark, d: X.json_ld_country(X.json_ld(S.company_sites(spark, d))))
register("x15_job_postings", O.POSTINGS_SQL)(lambda spark, d: X.job_postings(X.json_ld(_ckpt(S.company_sites(spark, d)))).select(
    "page_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "title", "url"))

register("w3_career_pages", O.CAREER_PAGES_SQL)(lambda spark, d: EN.career_pages(
    raw_candidates(spark, d).select(ensure_scheme(normalize_url(ustrip("website"))).alias("home")).distinct()
    .withColumn("home_domain", F.lower(netloc("home"))), EN.page_features(_ckpt(S.company_sites(spark, d)))))
register("q6_enrich", O.enriched_sql())(lambda spark, d: company_out(
    EN.enrich(D.dedupe_candidates(raw_candidates(spark, d)), _ckpt(S.company_sites(spark, d)))
    .withColumn("ord", D.candidate_order())))
register("w4_company_jobs", O.COMPANY_JOBS_SQL)(lambda spark, d: EN.company_jobs(
    raw_candidates(spark, d).select(
        F.concat(F.lit("https://"), domain_key(ensure_scheme("website")), F.lit("/careers")).alias("career_page_url"),
        F.lower(netloc(ensure_scheme("website"))).alias("company_domain")).distinct(),
    EN.page_features(_ckpt(S.company_sites(spark, d)))).select("career_page_url", "company_domain",
                                                                jobs_text().alias("jobs_text")))

register("j2_fill_websites", O.list_rows_sql(filled=True))(lambda spark, d: DIR.fill_websites(
    X.list_rows(S.list_pages(spark, d, "wikipedia")), _ckpt(S.detail_pages(spark, d))))
register("j4_crawl_directory", O.CRAWLED_LISTINGS_SQL)(lambda spark, d: DIR.crawl_directory(_ckpt(S.directory_pages(spark, d)), S.DIRECTORY_ROOT))
register("j5_crawl_profiles", O.CRAWLED_PROFILES_SQL)(lambda spark, d: DIR.crawl_profiles(
    _ckpt(S.profile_pages(spark, d, "clutch")), S.seeds(spark, d), "clutch", "clutch.co", "profile"))
register("q8_build_directory", O.directory_sql(EUROPE_COUNTRIES))(lambda spark, d: D.union_sources(DIR.build_directory(
    _ckpt(S.crawl_snapshot(spark, d)), S.seeds(spark, d), S.DIRECTORY_ROOT)).select(*DIR.CANDIDATE_COLS))


def _scratch(spark, label):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _health_out(df):
    return df.select("candidates.*", "enriched_with_careers", "final_merged", F.to_json("final_by_source").alias("final_by_source"))


def _run(spark, d):
    """The whole build; what it returns is read back from the snapshot that the build wrote."""
    path = _scratch(spark, "index")
    B.run_index(_ckpt(S.crawl_snapshot(spark, d)), S.seeds(spark, d), S.DIRECTORY_ROOT, companies_path=path)
    return company_out(with_rank(SNAP.read_served_companies(spark, path), *Q.base_order()), "rank")


def _run_health(spark, d):
    """The health record that a whole build wrote, without its time stamp."""
    path = _scratch(spark, "health")
    B.run_index(_ckpt(S.crawl_snapshot(spark, d)), S.seeds(spark, d), S.DIRECTORY_ROOT, health_path=path)
    return _health_out(SNAP.read_health(spark, path))


def _health_roundtrip(spark, d):
    path = _scratch(spark, "health")
    cands = candidates_with_ord(spark, d)
    SNAP.write_health(H.health(cands, D.dedupe_candidates(cands), final_records(cands), served(spark, d)), path)
    return _health_out(SNAP.read_health(spark, path))


register("q9_run_index", O.INDEX_SQL)(_run)
register("q4_source_health", O.source_health_sql(EUROPE_COUNTRIES))(_run_health)
register("s4_health_roundtrip", O.candidate_health_sql())(_health_roundtrip)


def _companies_roundtrip(spark, d):
    path = _scratch(spark, "companies")
    SNAP.write_companies(final_records(candidates_with_ord(spark, d)), path)
    return company_out(SNAP.read_companies(spark, path))


register("s1_read_companies", f"WITH {O.final_records_cte()} SELECT {CO_SQL} FROM fr")(_companies_roundtrip)


def _snapshot_roundtrip(spark, d):
    path = _scratch(spark, "companies")
    SNAP.write_companies(served(spark, d), path)
    return company_out(SNAP.read_served_companies(spark, path))


register("s3_s2_snapshot_roundtrip", O.with_served(f"SELECT {CO_SQL} FROM served"))(_snapshot_roundtrip)
