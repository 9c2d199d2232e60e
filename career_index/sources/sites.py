"""Crawl-snapshot fixtures built from the driver tables with plain SQL string expressions.

Each builder returns ``(page_id, url, html)`` rows whose expected extraction result is the
base table itself. Pages are bounded in size (list pages are chunked), and every page type
scales with the base table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_index.sources.tables import spread, table

# ------------------------------------------------------------------ company sites

# One site per customer; its domain id ``did`` is the customer's key.
DID_SQL = "CAST(c_custkey AS BIGINT)"
HOME_SQL = (
    "concat('<html><head><title>C', CAST(did AS STRING), ' home</title></head><body><nav>', "
    "'<a href=\"/about\">About us</a>', "
    "CASE WHEN did % 7 = 0 THEN '' "
    "WHEN did % 7 = 1 THEN '<a href=\"/team\" aria-label=\"Open jobs\">Team</a>' "
    "WHEN did % 7 = 2 THEN '<a href=\"/team\" title=\"Work with us\">Team</a><a href=\"/careers\">Careers</a>' "
    "ELSE '<a href=\"/careers\">Careers</a>' END, "
    "'<a href=\"https://www.linkedin.com/company/c', CAST(did AS STRING), '\">Our careers on LinkedIn</a>', "
    "CASE WHEN did % 2 = 0 THEN concat('<a href=\"https://c', CAST(did AS STRING), '.example.com/jobs#open\">Jobs</a>') ELSE '' END, "
    "'</nav><p>Welcome.</p></body></html>')"
)


def _did_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    return spread(cust.selectExpr(f"{DID_SQL} AS did", "c_nationkey"))


def company_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homepages, about pages and career pages of the candidate companies."""
    d = _did_rows(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    d = d.join(nation, d.c_nationkey == nation.n_nationkey, "left")
    # Career page: JSON-LD postings, then 10 to 40 job anchors.
    d = d.selectExpr("did", "n_name", "array_join(transform(sequence(1, CAST(10 + 10 * (did % 4) AS INT)), "
                     f"s -> {JOB_ANCHOR_SQL}), '') AS anchors")
    site, www = "concat('https://c', CAST(did AS STRING), '.example.com", "concat('https://www.c', CAST(did AS STRING), '.example.com"
    about = "'<html><head><title>About</title></head><body><h1>About</h1><p>We build things.</p></body></html>'"
    team = "'<html><head><title>Team</title></head><body><p>We have   OPEN positions in Lisbon.</p></body></html>'"
    careers = f"{site}', CASE WHEN did % 7 = 0 THEN '/en/jobs' WHEN did % 7 = 1 THEN '/team-jobs' ELSE '/careers' END)"
    kinds = (("true", f"{site}/')", HOME_SQL), ("true", f"{www}')", HOME_SQL), ("did % 3 = 0", f"{site}/about')", about),
             ("did % 7 IN (1, 2)", f"{site}/team')", team), ("true", careers, CAREER_PAGE_SQL), ("did % 2 = 0", f"{site}/jobs')", CAREER_PAGE_SQL))
    # All pages of a site come from one row, so that every task has pages of all kinds.
    site_pages = ", ".join(f"CASE WHEN {when} THEN named_struct('page_id', did * 100 + {k}, 'url', {url}, 'html', {html}) END"
                           for k, (when, url, html) in enumerate(kinds, 1))
    return d.selectExpr(f"explode(array({site_pages})) AS p").where("p IS NOT NULL").select("p.*")


JOB_ANCHOR_SQL = (
    "CASE s % 6 WHEN 0 THEN '<a href=\"/privacy\">Privacy policy for jobs</a>' "
    "WHEN 1 THEN concat('<a href=\"https://jobs.lever.co/c', CAST(did AS STRING), '/', CAST(s AS STRING), '\">Apply: Role ', CAST(s AS STRING), '</a>') "
    "WHEN 2 THEN concat('<a href=\"/jobs/', CAST(s AS STRING), '\">Open  position ', CAST(s AS STRING), '</a>') "
    "WHEN 3 THEN concat('<a href=\"https://other', CAST(did AS STRING), '.example.org/jobs/', CAST(s AS STRING), '\">Jobs elsewhere</a>') "
    "WHEN 4 THEN concat('<a href=\"/jobs/', CAST(s - 2 AS STRING), '/\">Duplicate role</a>') "
    "ELSE concat('<a href=\"/team/', CAST(s AS STRING), '\">Meet ', CAST(s AS STRING), '</a>') END"
)

CAREER_PAGE_SQL = (
    "concat('<html><head><title>Careers at C', CAST(did AS STRING), '</title>', "
    "'<script type=\"application/ld+json\">{\"@context\": \"https://schema.org\", \"@graph\": [', "
    "'{\"@type\": \"JobPosting\", \"title\": \" Engineer ', CAST(did AS STRING), '\", \"url\": \"https://c', CAST(did AS STRING), '.example.com/jobs/e#x\"}, ', "
    "'{\"@type\": [\"Thing\", \"JobPosting\"], \"title\": \"Analyst\", \"url\": \"https://boards.greenhouse.io/c', CAST(did AS STRING), '/2/\", ', "
    "'\"hiringOrganization\": {\"@type\": \"JobPosting\", \"title\": \"Nested\", \"url\": \"https://c', CAST(did AS STRING), '.example.com/jobs/n\"}}, ', "
    "'{\"@type\": \"JobPosting\", \"title\": \"\", \"url\": \"https://c', CAST(did AS STRING), '.example.com/jobs/blank\"}]}</script>', "
    "CASE WHEN did % 5 = 0 THEN '<script type=\"application/ld+json\">{not json</script>' ELSE '' END, "
    "'<script type=\"application/ld+json\">{\"@type\": \"Organization\", \"address\": {\"addressCountry\": \" ', "
    "coalesce(n_name, ''), '\"}}</script></head><body><h1>Join us</h1>', anchors, '</body></html>')"
)

# ------------------------------------------------------------------ encyclopedia lists

LIST_ROW_SQL = (
    "concat('<tr><td>', CAST(s_suppkey AS STRING), '</td><td>', "
    "CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('<a href=\"/wiki/Supplier_', CAST(s_suppkey AS STRING), '\">', s_name, '</a>[', "
    "CAST(s_suppkey % 3 AS STRING), ']') END, '</td><td>', "
    "'<a href=\"https://en.wikipedia.org/wiki/N', CAST(s_nationkey AS STRING), '\">', n_name, '</a><sup>[a]</sup></td><td>', "
    "CASE s_suppkey % 4 WHEN 0 THEN '' "
    "WHEN 1 THEN concat('<a href=\"https://s', CAST(s_suppkey AS STRING), '.example.com/\">site</a>') "
    "WHEN 2 THEN concat('<a href=\"/wiki/Web\">w</a> <a href=\"http://s', CAST(s_suppkey AS STRING), '.example.com/home\">home</a>') "
    "ELSE concat('<a href=\"https://s', CAST(s_suppkey % 50 AS STRING), '.example.com\">shared</a>') END, '</td></tr>')"
)
LIST_HEAD_SQL = ("CASE WHEN chunk % 2 = 0 THEN '<table class=\"wikitable sortable\"><tr><th>Rank</th><th>Company name</th>"
                 "<th>Headquarters</th><th>Website</th></tr><tr><th colspan=\"4\">Top</th></tr>' "
                 "ELSE '<table class=\"wikitable\"><tr><th>No.</th><th>Corporation</th><th>Country</th><th>Web</th></tr>' END")


def list_pages(spark: SparkSession, sf_dir: str, kind: str = "wikipedia") -> DataFrame:
    """Encyclopedia list pages: one per (region, chunk of 25 suppliers); rows are suppliers."""
    sup = spread(table(spark, sf_dir, "supplier"))
    nat = table(spark, sf_dir, "nation")
    rows = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
    rows = rows.selectExpr("n_regionkey", "CAST(floor(s_suppkey / 25) AS BIGINT) AS chunk", "s_suppkey",
                           f"{LIST_ROW_SQL} AS r")
    agg = rows.groupBy("n_regionkey", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "r"))), lambda x: x["r"]), "").alias("body"))
    prefix = "List_of_largest_companies" if kind == "wikipedia" else "List_of_largest_companies_global"
    return agg.selectExpr(
        f"{1 if kind == 'wikipedia' else 2} * 1000000000 + n_regionkey * 1000000 + chunk AS page_id",
        f"concat('https://en.wikipedia.org/wiki/{prefix}_R', CAST(n_regionkey AS STRING), '_', CAST(chunk AS STRING)) AS url",
        f"concat('<html><body>', {LIST_HEAD_SQL}, body, '</table></body></html>') AS html")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article page per supplier: a website in the infobox (key % 8 = 0), else an official-website list item."""
    sup = spread(table(spark, sf_dir, "supplier"))
    return sup.selectExpr(
        "3000000000 + s_suppkey AS page_id",
        "concat('https://en.wikipedia.org/wiki/Supplier_', CAST(s_suppkey AS STRING)) AS url",
        "concat('<html><body><table class=\"infobox vcard\"><tr><th>Type</th><td>Private</td></tr>', "
        "CASE WHEN s_suppkey % 8 = 0 THEN concat('<tr><th>Official Website</th><td><a href=\"https://en.wikipedia.org/x\">w</a> "
        "<a href=\"https://s', CAST(s_suppkey AS STRING), '.example.org/\">site</a></td></tr>') ELSE '' END, "
        "'</table><ul><li id=\"t-officialwebsite\"><a href=\"https://s', CAST(s_suppkey AS STRING), '.example.net\">web</a></li></ul>', "
        "'</body></html>') AS html")


# ------------------------------------------------------------------ listing directory

DIRECTORY_ROOT = "https://www.startups.example.eu/directory/"
CATEGORY_PATH_SQL = "concat('/directory/wpbdp_category/n', CAST(c_nationkey AS STRING), '/p', CAST(chunk AS STRING))"


def directory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root page (links to the numbered pages of each nation's category), category pages of at most 20 customers, listing pages."""
    nat = table(spark, sf_dir, "nation")
    cust = spread(table(spark, sf_dir, "customer")).withColumn("chunk", F.expr("CAST(floor(c_custkey / 500) AS BIGINT)"))
    cat_links = cust.select("c_nationkey", "chunk").distinct().selectExpr(
        "c_nationkey", "chunk", f"concat('<a href=\"', {CATEGORY_PATH_SQL}, '/\">', CAST(chunk AS STRING), '</a>') AS a")
    root = cat_links.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_nationkey", "chunk", "a"))),
                                                  lambda x: x["a"]), "").alias("links")).selectExpr(
        "4000000000 AS page_id", f"'{DIRECTORY_ROOT}' AS url",
        "concat('<html><body><div class=\"cats\">', links, regexp_extract(links, '<a.*?</a>', 0), '</div></body></html>') AS html")
    items = cust.selectExpr("c_nationkey", "chunk", "c_custkey",
                            "concat('<h2 class=\"listing-title\"><a href=\"/directory/listing/c', CAST(c_custkey AS STRING), "
                            "'/\">Customer ', CAST(c_custkey AS STRING), '</a></h2>', "
                            "CASE WHEN c_custkey % 9 = 0 THEN '<h2 class=\"listing-title\"><a href=\"/directory/?wpbdp_view=all\">all</a></h2>' ELSE '' END) AS a")
    cats = items.groupBy("c_nationkey", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "a"))), lambda x: x["a"]), "").alias("links"))
    cats = cats.selectExpr(
        "4100000000 + c_nationkey * 1000000 + chunk AS page_id",
        f"concat('https://www.startups.example.eu', {CATEGORY_PATH_SQL}) AS url",
        "concat('<html><body>', links, '</body></html>') AS html")
    listing = cust.join(nat, cust.c_nationkey == nat.n_nationkey).selectExpr(
        "4200000000 + c_custkey AS page_id",
        f"concat('{DIRECTORY_ROOT}listing/c', CAST(c_custkey AS STRING)) AS url",
        "concat('<html><body><h1>', CASE WHEN c_custkey % 11 = 0 THEN concat('www.c', CAST(c_custkey AS STRING), '.example.com') "
        "ELSE concat('Customer ', CAST(c_custkey AS STRING)) END, '</h1>', "
        "'<div class=\"wpbdp-field-business_name\"><span class=\"value\">Biz ', CAST(c_custkey AS STRING), '</span></div>', "
        "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat('<div class=\"wpbdp-field-website\"><span class=\"value\">see https://c', "
        "CAST(c_custkey AS STRING), '.example.com/x).</span></div>') END, "
        "'<div class=\"wpbdp-field-category\"><span class=\"value\">', n_name, '</span></div></body></html>') AS html")
    return root.unionByName(cats).unionByName(listing)


# ------------------------------------------------------------------ profile directories

PROFILE_HOSTS = {"clutch": ("https://clutch.co", "profile"), "themanifest": ("https://themanifest.com", "company")}


def profile_pages(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """List pages (one per region, chunks of 20 suppliers) and supplier profile pages."""
    host, marker = PROFILE_HOSTS[source]
    base_id = 5000000000 if source == "clutch" else 6000000000
    sup = spread(table(spark, sf_dir, "supplier"))
    nat = table(spark, sf_dir, "nation")
    s = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
    entry = s.selectExpr("n_regionkey", "CAST(floor(s_suppkey / 20) AS BIGINT) AS chunk", "s_suppkey",
                         f"concat('<a href=\"/{marker}/s', CAST(s_suppkey AS STRING), '\">', s_name, '</a>') AS a")
    lists = entry.groupBy("n_regionkey", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "a"))), lambda x: x["a"]), "").alias("links"))
    lists = lists.selectExpr(
        f"{base_id} + n_regionkey * 1000000 + chunk AS page_id",
        f"concat('{host}/list/r', CAST(n_regionkey AS STRING), '/', CAST(chunk AS STRING)) AS url",
        "concat('<html><head><script type=\"application/ld+json\">[{\"url\": \"" + host + "/" + marker + "/featured-company\"}, 7]</script>', "
        "CASE WHEN chunk % 7 = 3 THEN '<title>Just a moment...</title><div id=\"cf-challenge\"></div>' ELSE '' END, "
        "'</head><body>', links, '<a href=\"/about\">about</a></body></html>') AS html")
    prof = s.selectExpr(
        f"{base_id} + 900000000 + s_suppkey AS page_id",
        f"concat('{host}/{marker}/s', CAST(s_suppkey AS STRING)) AS url",
        "concat('<html><head><script type=\"application/ld+json\">{\"@type\": \"Organization\", \"address\": "
        "{\"addressCountry\": \"', n_name, '\"}}</script></head><body>', "
        "CASE WHEN s_suppkey % 17 = 0 THEN '<p>just a moment</p><div class=\"cf-challenge\"></div>' ELSE '' END, "
        "'<h1>', s_name, '</h1><a href=\"" + host + "/reviews\">Reviews website</a>', "
        "'<a href=\"https://social.example.com/s', CAST(s_suppkey AS STRING), '\">Social</a>', "
        "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('<a href=\"https://s', CAST(s_suppkey AS STRING), "
        "'.example.com/\" title=\"Visit Website\">Go</a>') END, '</body></html>') AS html")
    return lists.unionByName(prof)


def crawl_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixture pages plus the driver ``pages`` table: the crawl snapshot used by the index build."""
    parts = [table(spark, sf_dir, "pages"), company_sites(spark, sf_dir), list_pages(spark, sf_dir, "wikipedia"),
             list_pages(spark, sf_dir, "wikipedia_global"), detail_pages(spark, sf_dir), directory_pages(spark, sf_dir),
             profile_pages(spark, sf_dir, "clutch"), profile_pages(spark, sf_dir, "themanifest")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Dealt by page, so that every file of a stored snapshot, and every task that reads it, has its share of the heavy pages.
    rows = sum(table(spark, sf_dir, t).count() for t in ("pages", "customer", "supplier"))
    return spread(out, "page_id", rows=rows)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, list_rank, url): the list pages each source starts from, in page-id order."""
    def ranked(df, source):
        return df.selectExpr(f"'{source}' AS source", "page_id", "url")
    parts = [ranked(list_pages(spark, sf_dir, "wikipedia"), "wikipedia"),
             ranked(list_pages(spark, sf_dir, "wikipedia_global"), "wikipedia_global"),
             ranked(profile_pages(spark, sf_dir, "clutch").where("url LIKE '%/list/%'"), "clutch"),
             ranked(profile_pages(spark, sf_dir, "themanifest").where("url LIKE '%/list/%'"), "themanifest")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Seeds are one row per list page (a small table); rank 1..n per source in page-id order.
    from pyspark.sql import Window
    w = Window.partitionBy("source").orderBy("page_id")
    return out.select("source", F.row_number().over(w).cast("long").alias("list_rank"), "url")
