"""DuckDB SQL used as an independent oracle for the registered queries.

Each fragment builder returns DuckDB SQL text for one of our Column expressions. DuckDB runs
RE2 (``\\s`` is ASCII whitespace, which is all the fixtures contain) and 1-based lists.
"""

from __future__ import annotations

from career_index.sources.fixtures import ORD_SOURCE_STRIDE, duckdb_raw_candidates_sql

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def name_key(x: str) -> str:
    return strip(collapse(f"lower({x})"))


def clean_cell(x: str) -> str:
    return strip(collapse(rf"regexp_replace({x}, '\[[^\]]+\]', '', 'g')"))


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '{NETLOC}', 1)"


def domain_key(x: str) -> str:
    return rf"regexp_replace(lower({netloc(x)}), '^www\.', '')"


def ensure_scheme(x: str) -> str:
    return f"(CASE WHEN starts_with({x}, 'http://') OR starts_with({x}, 'https://') THEN {x} ELSE 'https://' || {x} END)"


def final_url(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    u = ensure_scheme(s)
    return (f"(CASE WHEN {s} <> '' AND contains({netloc(u)}, '.') AND length({u}) <= 220 "
            f"THEN regexp_replace({u}, '/$', '') ELSE '' END)")


def normalize_url(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace({strip(x)}, '[\t\r\n]', '', 'g'), '(?s)#.*$', ''), '^([^?]*)\?$', '\1')"
    low = (f"(CASE WHEN regexp_matches({s}, '{SCHEME}') THEN lower(regexp_extract({s}, '{SCHEME}', 1)) || "
           rf"regexp_extract({s}, '(?s)^[A-Za-z][A-Za-z0-9+.\-]*(:.*)$', 1) ELSE {s} END)")
    return f"regexp_replace({low}, '/$', '')"


def jobs_text(x: str) -> str:
    """Array of jobs as one comparable string."""
    return f"array_to_string(list_transform({x}, lambda j: j.title || ' | ' || j.url), ' ; ')"


def raw_candidates() -> str:
    return duckdb_raw_candidates_sql()


def final_records_cte() -> str:
    """CTEs ``rc`` (raw candidates), ``fr0`` / ``fr`` (F2 gate with W5 job cleaning)."""
    country = strip("coalesce(country_of_origin, '')")
    source = strip("coalesce(source, '')")
    jt = strip("coalesce(j.title, '')")
    nm = strip("coalesce(name, '')")
    jobs_v = (f"list_filter(list_transform(coalesce(jobs, []), lambda j: {{'title': {jt}, "
              f"'url': {final_url('j.url')}}}), lambda j: j.title <> '' AND j.url <> '')")
    return (
        f"rc AS {raw_candidates()},\n"
        f"fr0 AS (SELECT source_rank, seq, CAST(source_rank AS BIGINT) * {ORD_SOURCE_STRIDE} + seq AS ord, "
        f"{nm} AS name, {final_url('website')} AS website, "
        f"{final_url('career_page_url')} AS career_page_url, "
        f"CASE WHEN {country} = '' THEN 'Unknown' ELSE {country} END AS country_of_origin, "
        f"CASE WHEN {source} = '' THEN 'unknown' ELSE {source} END AS source, {jobs_v} AS jv FROM rc),\n"
        "fr AS (SELECT source_rank, seq, ord, name, website, career_page_url, country_of_origin, source, "
        "list_filter(jv, lambda j, i: list_position(list_transform(jv, lambda y: lower(y.title) || '|' || lower(y.url)), "
        "lower(j.title) || '|' || lower(j.url)) = i) AS jobs FROM fr0 "
        "WHERE name <> '' AND website <> '' AND career_page_url <> '')"
    )


def served_cte() -> str:
    """``served``: F2 records, first per domain key."""
    return (final_records_cte() + ",\n"
            f"served AS (SELECT ord, name, website, career_page_url, country_of_origin, source, jobs FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY {domain_key('website')} ORDER BY ord) AS rn FROM fr) "
            "WHERE rn = 1)")


def with_served(select_sql: str) -> str:
    return "WITH " + served_cte() + "\n" + select_sql


def swapcase(x: str) -> str:
    lo = "abcdefghijklmnopqrstuvwxyz"
    return f"translate({x}, '{lo}{lo.upper()}', '{lo.upper()}{lo}')"


def locale_key(x: str, desc: bool = False) -> str:
    """ICU root order on ASCII letters, digits and spaces: case-insensitive first, then
    lower-case before upper-case."""
    d = " DESC" if desc else ""
    return f"lower({x}){d}, {swapcase(x)}{d}"


def canonical_origin(x: str) -> str:
    m = rf"regexp_extract({x}, '(?i)(https?://[^\s]+|www\.[^\s]+)', 1)"
    v = rf"regexp_replace({strip(m)}, '[.,;)]+$', '')"
    u = ensure_scheme(v)
    return (f"(CASE WHEN {m} <> '' AND contains({netloc(u)}, '.') AND length({u}) <= 200 "
            f"THEN lower(regexp_extract({u}, '{SCHEME}', 1)) || '://' || {netloc(u)} ELSE '' END)")


def decode(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"),
                    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def tag_text(x: str) -> str:
    return strip(collapse(decode(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")))


def attr(tag: str, name: str) -> str:
    pat = rf"(?is)^<\w+(?:\s[^>]*?)?\s{name}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))"
    return decode(f"(regexp_extract({tag}, '{pat}', 1) || regexp_extract({tag}, '{pat}', 2) || "
                  f"regexp_extract({tag}, '{pat}', 3))")


ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"


def anchors_sql(src: str, keep: str) -> str:
    """Rows (keep..., pos, href, text, title, aria_label) for anchors of ``src`` (which has ``html``)."""
    ot = r"regexp_extract(a, '(?is)^(<a\s[^>]*>)', 1)"
    inner = r"regexp_extract(a, '(?is)^<a\s[^>]*>(.*)</a>$', 1)"
    return (f"SELECT {keep}, pos, {strip(attr(ot, 'href'))} AS href, {tag_text(inner)} AS text, "
            f"{strip(attr(ot, 'title'))} AS title, {strip(attr(ot, 'aria-label'))} AS aria_label FROM ("
            f"SELECT {keep}, unnest(al) AS a, generate_subscripts(al, 1) - 1 AS pos FROM ("
            f"SELECT {keep}, regexp_extract_all(html, '{ANCHOR}') AS al FROM {src})) "
            rf"WHERE regexp_matches({ot}, '(?is)^<\w+(?:\s[^>]*?)?\shref\s*=')")


def resolve_sql(src: str, keep: str, base: str, href: str) -> str:
    """Two-stage standard-library-style join of ``href`` against ``base`` -> column ``joined``."""
    parts = (
        f"SELECT {keep}, {base} AS b, {href} AS h, lower(regexp_extract({base}, '{SCHEME}', 1)) AS bs, "
        f"lower(regexp_extract({href}, '{SCHEME}', 1)) AS hs, regexp_matches({href}, '{SCHEME}') AS hhs, "
        f"{netloc(base)} AS bn, regexp_matches({base}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//') AS bhn, "
        f"regexp_extract({base}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS bp, "
        f"regexp_extract({base}, '^[^?#]*\\?([^#]*)', 1) AS bq FROM {src}")
    rest = "(CASE WHEN hhs THEN regexp_extract(h, '(?s)^[A-Za-z][A-Za-z0-9+.\\-]*:(.*)$', 1) ELSE h END)"
    p2 = (f"SELECT *, CASE WHEN hhs THEN hs ELSE bs END AS es, {rest} AS hr, "
          f"regexp_extract({rest}, '^([^?#]*)', 1) AS hp, regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1) AS hq, "
          f"regexp_extract({rest}, '(?s)^[^#]*#(.*)$', 1) AS hf FROM ({parts})")
    segs = ("(CASE WHEN starts_with(hp, '/') THEN string_split(hp, '/') ELSE "
            "(SELECT CASE WHEN len(m) >= 2 THEN [m[1]] || list_filter(m[2:len(m)-1], lambda s: s <> '') || [m[len(m)]] ELSE m END "
            "FROM (SELECT (CASE WHEN string_split(bp, '/')[-1] <> '' THEN string_split(bp, '/')[1:len(string_split(bp, '/'))-1] "
            "ELSE string_split(bp, '/') END) || string_split(hp, '/') AS m)) END)")
    p3 = f"SELECT *, {segs} AS sg FROM ({p2})"
    red = ("list_reduce(sg, lambda acc, x: CASE WHEN x = '..' THEN acc[1:len(acc)-1] WHEN x = '.' THEN acc "
           "ELSE list_append(acc, x) END, []::VARCHAR[])")
    p4 = (f"SELECT *, CASE WHEN sg[-1] IN ('.', '..') THEN list_append({red}, '') ELSE {red} END AS rs FROM ({p3})")
    joined = "array_to_string(rs, '/')"
    path = (f"(CASE WHEN {joined} = '' THEN '/' WHEN starts_with({joined}, '/') THEN {joined} ELSE '/' || {joined} END)")
    sp = "(CASE WHEN es <> '' THEN es || ':' ELSE '' END)"
    prefix = f"({sp} || CASE WHEN bhn THEN '//' || bn ELSE '' END)"

    def tail(q, f):
        return f"(CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END || CASE WHEN {f} <> '' THEN '#' || {f} ELSE '' END)"
    res = (f"CASE WHEN b = '' THEN h WHEN h = '' THEN b "
           f"WHEN (hhs AND hs <> bs) OR es NOT IN ('http', 'https', '') THEN h "
           f"WHEN starts_with(hr, '//') THEN {sp} || hr "
           f"WHEN hp = '' THEN {prefix} || bp || {tail('CASE WHEN hq <> ' + chr(39) * 2 + ' THEN hq ELSE bq END', 'hf')} "
           f"ELSE {prefix} || {path} || {tail('hq', 'hf')} END")
    return f"SELECT *, {res} AS joined FROM ({p4})"


def links_sql() -> str:
    """X1 over ``pages``."""
    a = anchors_sql("(SELECT page_id, url AS page_url, html FROM pages)", "page_id, page_url")
    r = resolve_sql(f"({a})", "page_id, page_url, pos, href, text, title, aria_label", "page_url", "href")
    return (f"SELECT page_id, page_url, pos, href, text, title, aria_label, {normalize_url('joined')} AS absolute "
            f"FROM ({r})")


def page_text_sql() -> str:
    raw_title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    body = "regexp_replace(html, '(?is)<template\\b.*?</template>', ' ', 'g')"
    return (f"SELECT page_id, CASE WHEN contains({raw_title}, '<') THEN '' ELSE {decode(raw_title)} END AS title, "
            f"{tag_text(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>' + chr(39) + ', 1)')} AS h1, "
            f"{tag_text(body)} AS body FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', "
            "' ', 'g') AS html FROM pages)")


# ------------------------------------------------------- extraction results, from the base tables alone


def sup_nation() -> str:
    return "(SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def list_rows_sql(filled: bool = False) -> str:
    """List rows; ``filled``: with the websites of the article pages."""
    none = ("CASE WHEN s_suppkey % 8 = 0 THEN 'https://s' || s_suppkey || '.example.org' "
            "ELSE 'https://s' || s_suppkey || '.example.net' END") if filled else "''"
    return (
        "SELECT 1000000000 + n_regionkey * 1000000 + chunk AS page_id, 0 AS table_pos, "
        "CASE WHEN chunk % 2 = 0 THEN 2 ELSE 1 END + place - 1 AS row_pos, s_name AS name, "
        f"CASE s_suppkey % 4 WHEN 0 THEN {none} WHEN 1 THEN 'https://s' || s_suppkey || '.example.com' "
        "WHEN 2 THEN 'http://s' || s_suppkey || '.example.com/home' ELSE 'https://s' || s_suppkey % 50 || '.example.com' END "
        "AS website, n_name AS country, 'https://en.wikipedia.org/wiki/Supplier_' || s_suppkey AS company_wiki_url FROM ("
        "SELECT *, s_suppkey // 25 AS chunk, row_number() OVER (PARTITION BY n_regionkey, s_suppkey // 25 ORDER BY s_suppkey) "
        f"AS place FROM {sup_nation()}) WHERE s_suppkey % 13 <> 0")


INFOBOX_SQL = ("SELECT 3000000000 + s_suppkey AS page_id, 'https://s' || s_suppkey || "
               "CASE WHEN s_suppkey % 8 = 0 THEN '.example.org' ELSE '.example.net' END AS website FROM supplier")

LISTING_SQL = (
    "SELECT 4200000000 + c_custkey AS page_id, CASE WHEN c_custkey % 11 = 0 THEN 'Biz ' ELSE 'Customer ' END || c_custkey AS name, "
    "'https://c' || c_custkey || '.example.com' AS website, n_name AS country_of_origin, 'eu_startups' AS source, "
    "'https://www.startups.example.eu/directory/listing/c' || c_custkey AS source_url "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0")

_CATEGORY = "'https://www.startups.example.eu/directory/wpbdp_category/n' || c_nationkey || '/p' || c_custkey // 500"
CATEGORY_SQL = (f"SELECT 4000000000 AS page_id, {_CATEGORY} AS url, row_number() OVER (ORDER BY c_nationkey, c_custkey // 500) - 1 AS pos "
                "FROM (SELECT DISTINCT c_nationkey, c_custkey // 500 * 500 AS c_custkey FROM customer)")

LISTING_URLS_SQL = (
    "SELECT 4100000000 + c_nationkey * 1000000 + c_custkey // 500 AS page_id, "
    "'https://www.startups.example.eu/directory/listing/c' || c_custkey AS url, CAST(row_number() OVER w - 1 + "
    "coalesce(sum(CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_pos FROM customer "
    "WINDOW w AS (PARTITION BY c_nationkey, c_custkey // 500 ORDER BY c_custkey)")

PROFILE_SQL = (
    "SELECT 6900000000 + s_suppkey AS page_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'https://social.example.com/s' "
    "|| s_suppkey ELSE 'https://s' || s_suppkey || '.example.com' END AS website, n_name AS country_of_origin, "
    "'themanifest' AS source, 'https://themanifest.com/company/s' || s_suppkey AS source_url FROM " + sup_nation())

_CAREER_PAGES = ("(SELECT c_custkey AS k, c_nationkey, c_custkey * 100 + 5 AS page_id FROM customer UNION ALL "
                 "SELECT c_custkey, c_nationkey, c_custkey * 100 + 6 FROM customer WHERE c_custkey % 2 = 0)")

LD_COUNTRY_SQL = f"SELECT page_id, n_name AS country FROM {_CAREER_PAGES} JOIN nation ON c_nationkey = n_nationkey"

POSTINGS_SQL = (
    f"SELECT page_id, '0.1.0' AS path, 'Engineer ' || k AS title, 'https://c' || k || '.example.com/jobs/e' AS url FROM {_CAREER_PAGES} "
    f"UNION ALL SELECT page_id, '0.1.1', 'Analyst', 'https://boards.greenhouse.io/c' || k || '/2' FROM {_CAREER_PAGES} "
    f"UNION ALL SELECT page_id, '0.1.1.3', 'Nested', 'https://c' || k || '.example.com/jobs/n' FROM {_CAREER_PAGES}")

ALLOWED_SQL = (
    "SELECT page_id, url FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, "
    "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages) WHERE NOT starts_with(path, "
    "CASE WHEN starts_with(host, 'blog.') THEN '/en/' ELSE '/fr/' END)")


# ------------------------------------------------------- crawls and the index build, from the base tables alone

PROFILE_URLS_SQL = (
    "WITH l AS (SELECT n_regionkey, s_suppkey // 20 AS chunk, s_suppkey, 5000000000 + n_regionkey * 1000000 + s_suppkey // 20 AS page_id "
    f"FROM {sup_nation()}) SELECT DISTINCT page_id, 0 AS stage, 'https://clutch.co/profile/featured-company' AS url FROM l "
    "UNION ALL SELECT page_id, 1, 'https://clutch.co/profile/s' || s_suppkey FROM l")

JSON_LD_SQL = (
    "SELECT page_id, 0 AS script_pos, length('{\"@context\": \"https://schema.org\", \"@graph\": [{\"@type\": \"JobPosting\", "
    "\"title\": \" Engineer ' || k || '\", \"url\": \"https://c' || k || '.example.com/jobs/e#x\"}, {\"@type\": [\"Thing\", \"JobPosting\"], "
    "\"title\": \"Analyst\", \"url\": \"https://boards.greenhouse.io/c' || k || '/2/\", \"hiringOrganization\": {\"@type\": \"JobPosting\", "
    "\"title\": \"Nested\", \"url\": \"https://c' || k || '.example.com/jobs/n\"}}, {\"@type\": \"JobPosting\", \"title\": \"\", "
    f"\"url\": \"https://c' || k || '.example.com/jobs/blank\"}}]}}') AS raw_len FROM {_CAREER_PAGES} "
    "UNION ALL SELECT page_id, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END, "
    "length('{\"@type\": \"Organization\", \"address\": {\"addressCountry\": \" ' || n_name || '\"}}') "
    f"FROM {_CAREER_PAGES} JOIN nation ON c_nationkey = n_nationkey")

#: Links of company sites that mention a career keyword: (page_id, pos, absolute), first places of equal ones.
CAREER_LINKS_SQL = (
    "WITH h AS (SELECT c_custkey AS k, p, c_custkey * 100 + p AS page_id, "
    "'https://' || CASE WHEN p = 2 THEN 'www.' ELSE '' END || 'c' || c_custkey || '.example.com' AS site "
    "FROM customer, (SELECT unnest([1, 2]) AS p)), "
    "j AS (SELECT k, page_id, 'https://c' || k || '.example.com' AS site, unnest(range(1, 11 + 10 * (k % 4))) AS s "
    f"FROM {_CAREER_PAGES}), "
    "a AS (SELECT page_id, 1 AS pos, site || '/team' AS absolute FROM h WHERE k % 7 = 1 "
    "UNION ALL SELECT page_id, CASE WHEN k % 7 = 2 THEN 2 ELSE 1 END, site || '/careers' FROM h WHERE k % 7 > 1 "
    "UNION ALL SELECT page_id, CASE k % 7 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END, 'https://www.linkedin.com/company/c' || k FROM h "
    "UNION ALL SELECT page_id, CASE k % 7 WHEN 0 THEN 2 WHEN 2 THEN 4 ELSE 3 END, 'https://c' || k || '.example.com/jobs' FROM h WHERE k % 2 = 0 "
    "UNION ALL SELECT page_id, s - 1, CASE s % 6 WHEN 0 THEN site || '/privacy' WHEN 1 THEN 'https://jobs.lever.co/c' || k || '/' || s "
    "WHEN 2 THEN site || '/jobs/' || s WHEN 3 THEN 'https://other' || k || '.example.org/jobs/' || s ELSE site || '/jobs/' || (s - 2) END "
    "FROM j WHERE s % 6 <> 5) SELECT page_id, min(pos) AS pos, absolute FROM a GROUP BY page_id, absolute")


def career_path(k: str) -> str:
    """Where the career page of company ``k`` is found from its homepage."""
    return f"CASE WHEN {k} % 7 = 1 THEN '/team' WHEN {k} % 7 <> 0 THEN '/careers' WHEN {k} % 2 = 0 THEN '/jobs' ELSE '/en/jobs' END"


def page_jobs(k: str, own: str) -> str:
    """Jobs of a full career page of company ``k`` as text; ``own``: its relative links count as the company's."""
    site = f"'https://c' || {k} || '.example.com"
    return (f"array_to_string(['Engineer ' || {k} || ' | ' || {site}/jobs/e', 'Analyst | https://boards.greenhouse.io/c' || {k} || '/2', "
            f"'Nested | ' || {site}/jobs/n'] || list_transform(list_filter(range(1, 11 + 10 * ({k} % 4)), lambda s: s % 6 = 1 OR (s % 6 = 2 AND {own})), "
            f"lambda s: CASE WHEN s % 6 = 1 THEN 'Apply: Role ' || s || ' | https://jobs.lever.co/c' || {k} || '/' || s "
            f"ELSE 'Open position ' || s || ' | ' || {site}/jobs/' || s END), ' ; ')")


_DID = "c_custkey // 10 * 10 + (c_custkey * 3) % 5"
CAREER_PAGES_SQL = (
    f"SELECT DISTINCT 'https://c' || d || '.example.com' AS home, 'https://c' || d || '.example.com' || {career_path('d')} AS career_page_url "
    f"FROM (SELECT {_DID} AS d FROM customer WHERE c_custkey % 8 = 1) WHERE d IN (SELECT c_custkey FROM customer)")

COMPANY_JOBS_SQL = (
    "SELECT DISTINCT 'https://c' || d || '.example.com/careers' AS career_page_url, CASE WHEN www THEN 'www.' ELSE '' END || 'c' || d || '.example.com' "
    f"AS company_domain, {page_jobs('d', 'NOT www')} AS jobs_text FROM (SELECT {_DID} AS d, c_custkey % 8 = 0 AS www FROM customer "
    "WHERE c_custkey % 8 NOT IN (3, 4)) WHERE d % 7 > 1 AND d IN (SELECT c_custkey FROM customer)")


def enriched_sql() -> str:
    """Q6: the first candidate of each name and website whose homepage is in the snapshot."""
    jobs = f"CASE WHEN d % 7 = 1 THEN '' ELSE {page_jobs('d', 'true')} END"
    return (
        f"SELECT CAST(source_rank AS BIGINT) * {ORD_SOURCE_STRIDE} + seq AS ord, name, website, 'https://c' || d || '.example.com' || {career_path('d')} "
        f"AS career_page_url, country_of_origin, source, {jobs} AS jobs_text FROM (SELECT *, seq // 10 * 10 + (seq * 3) % 5 AS d, "
        f"row_number() OVER (PARTITION BY lower({strip('name')}), lower({strip('website')}) ORDER BY source_rank, seq) AS rn FROM {raw_candidates()}) "
        "WHERE rn = 1 AND seq % 8 = 1 AND d IN (SELECT c_custkey FROM customer)")


def resolved_sql() -> str:
    """Q7: the sequential rule as a recursion over the records in order, with two maps of keys and one of places."""
    score = ("(7 + (lower(country_of_origin) <> 'unknown')::INT + (lower(source) <> 'unknown')::INT + (len(jobs) > 0)::INT)")
    found = "CASE WHEN r.dk <> '' AND map_contains(st.doms, r.dk) THEN st.doms[r.dk] WHEN map_contains(st.names, r.nk) THEN st.names[r.nk] END"
    wins = ("(t.i IS NULL OR r.score > t.score OR (t.unk AND NOT r.unk) OR r.clen < t.clen)")
    return (
        f"WITH RECURSIVE {final_records_cte()}, r AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY ord) AS INT) AS i, ord, "
        f"{domain_key('website')} AS dk, {name_key('name')} AS nk, {score} AS score, lower(country_of_origin) = 'unknown' AS unk, "
        "length(career_page_url) AS clen FROM fr), "
        "st AS (SELECT 0 AS i, MAP {}::MAP(VARCHAR, INT) AS doms, MAP {}::MAP(VARCHAR, INT) AS names, MAP {}::MAP(INT, INT) AS places UNION ALL "
        f"SELECT r.i, CASE WHEN {wins} AND r.dk <> '' THEN map_concat(st.doms, MAP {{r.dk: r.i}}) ELSE st.doms END, "
        f"CASE WHEN {wins} THEN map_concat(st.names, MAP {{r.nk: r.i}}) ELSE st.names END, "
        f"CASE WHEN t.i IS NULL THEN map_concat(st.places, MAP {{r.i: r.i}}) WHEN {wins} AND map_contains(st.places, t.i) THEN "
        "map_concat(map_from_entries(list_filter(map_entries(st.places), lambda e: e.key <> t.i)), MAP {r.i: st.places[t.i]}) ELSE st.places END "
        f"FROM st JOIN r ON r.i = st.i + 1 LEFT JOIN r t ON t.i = ({found})), "
        "pl AS (SELECT unnest(map_entries(places)) AS e FROM st WHERE i = (SELECT max(i) FROM r)), "
        "w AS (SELECT o.ord AS slot, h.ord AS rec FROM pl JOIN r h ON h.i = e.key JOIN r o ON o.i = e.value) "
        "SELECT slot AS ord, name, website, career_page_url, country_of_origin, source, "
        f"{jobs_text('jobs')} AS jobs_text, row_number() OVER (ORDER BY lower(name), slot) AS rank FROM w JOIN fr ON fr.ord = w.rec")


def _lists(rank: int, source: str, prefix: str, countries) -> str:
    """List rows of a source: of each website the first row; the global list keeps European ones."""
    web = list_rows_sql(filled=True)
    keep = f"WHERE rn = 1 {'AND lower(country) IN (' + ', '.join(repr(c) for c in countries) + ')' if countries else ''}"
    return (
        f"SELECT {rank} AS source_rank, seq, name, website, country, '{source}' AS source, "
        f"'https://en.wikipedia.org/wiki/{prefix}_R' || (page_id - 1000000000) // 1000000 || '_' || page_id % 1000000 AS source_url FROM ("
        "SELECT *, row_number() OVER (PARTITION BY website ORDER BY seq) AS rn FROM ("
        f"SELECT *, row_number() OVER (ORDER BY page_id, row_pos) AS seq FROM ({web}))) {keep}")


def _profiles(rank: int, source: str, host: str, marker: str) -> str:
    """Profiles of one directory: those linked from list pages that are no challenge, but for profiles that are one."""
    return (
        f"SELECT {rank} AS source_rank, seq, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'https://social.example.com/s' || s_suppkey "
        f"ELSE 'https://s' || s_suppkey || '.example.com' END AS website, n_name AS country, '{source}' AS source, "
        f"'{host}/{marker}/s' || s_suppkey AS source_url FROM (SELECT *, 1 + row_number() OVER (ORDER BY n_regionkey, s_suppkey // 20, s_suppkey) AS seq "
        f"FROM {sup_nation()} WHERE (s_suppkey // 20) % 7 <> 3) WHERE s_suppkey % 17 <> 0")


LISTINGS_SQL = (
    "SELECT 2 AS source_rank, seq, CASE WHEN c_custkey % 11 = 0 THEN 'Biz ' ELSE 'Customer ' END || c_custkey AS name, "
    "'https://c' || c_custkey || '.example.com' AS website, n_name AS country, 'eu_startups' AS source, "
    "'https://www.startups.example.eu/directory/listing/c' || c_custkey AS source_url, c_custkey FROM ("
    "SELECT *, row_number() OVER (ORDER BY c_nationkey, c_custkey // 500, c_custkey) AS seq FROM customer) "
    "JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0")
PROFILES_SQL = _profiles(3, "clutch", "https://clutch.co", "profile")
_OUT = "seq, name, website, '' AS career_page_url, country AS country_of_origin, source, source_url"
CRAWLED_LISTINGS_SQL = f"SELECT {_OUT} FROM ({LISTINGS_SQL})"
CRAWLED_PROFILES_SQL = f"SELECT {_OUT} FROM ({PROFILES_SQL})"


def directory_sql(europe) -> str:
    """Q8: candidates of all sources."""
    parts = [_lists(0, "wikipedia", "List_of_largest_companies", None), _lists(1, "wikipedia_global", "List_of_largest_companies_global", europe),
             f"SELECT * EXCLUDE (c_custkey) FROM ({LISTINGS_SQL})", PROFILES_SQL, _profiles(4, "themanifest", "https://themanifest.com", "company")]
    return f"SELECT source_rank, {_OUT} FROM (" + " UNION ALL ".join(f"({p})" for p in parts) + ")"


#: Q9: only the listed customers have sites in the snapshot; their names and hosts are their own, so none are merged.
INDEX_SQL = (
    f"SELECT 2 * {ORD_SOURCE_STRIDE} + seq AS ord, name, website, website || {career_path('c_custkey')} AS career_page_url, country AS country_of_origin, "
    f"source, CASE WHEN c_custkey % 7 = 1 THEN '' ELSE {page_jobs('c_custkey', 'true')} END AS jobs_text, "
    f"row_number() OVER (ORDER BY lower(name), seq) AS rank FROM ({LISTINGS_SQL})")


def _health_row(raw: str, deduped: str, enriched: str, merged: str) -> str:
    sources = ("wikipedia", "wikipedia_global", "eu_startups", "clutch", "themanifest")
    counts = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in sources)
    by = (f"(SELECT '{{' || string_agg('\"' || source || '\":' || n, ',' ORDER BY source) || '}}' FROM (SELECT source, count(*) AS n FROM {merged} GROUP BY source))")
    return (f"SELECT {counts}, count(*) AS total_raw, (SELECT count(*) FROM {deduped}) AS total_deduped, "
            f"(SELECT count(*) FROM {enriched}) AS enriched_with_careers, (SELECT count(*) FROM {merged}) AS final_merged, {by} AS final_by_source FROM {raw}")


def source_health_sql(europe) -> str:
    """Q4 over the stages of Q9."""
    return (f"WITH raw AS ({directory_sql(europe)}), dd AS (SELECT DISTINCT lower({strip('name')}) AS n, lower({strip('website')}) AS w FROM raw), "
            f"ix AS ({INDEX_SQL}) " + _health_row("raw", "dd", "ix", "ix"))


def candidate_health_sql() -> str:
    """A2 / S4 over the candidate fixture: candidates, first ones, final records, served companies."""
    return (f"WITH {served_cte()}, dd AS (SELECT DISTINCT lower({strip('name')}) AS n, lower({strip('website')}) AS w FROM rc) "
            + _health_row("rc", "dd", "fr", "served"))
