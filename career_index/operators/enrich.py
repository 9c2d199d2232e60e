"""Crawl-snapshot fetch and career enrichment.

A fetch is an equi-join on the normalised URL against a page index that is unique on that key
(lowest ``page_id`` wins). Page-local extraction (anchors, text, JSON-LD) happens before any
join. Career search runs once per distinct home URL and job
extraction once per distinct (career page, company host): companies sharing a hub site do not
multiply the work, and the per-home groups are bounded by the links of one page.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from career_index.constants import COMMON_CAREER_PATHS
from career_index.functions import predicates as P
from career_index.functions.text import settled, ustrip
from career_index.functions.urls import ensure_scheme, netloc, normalize_url, resolve_url, url_path, with_absolute
from career_index.operators import extract as X
from career_index.storage import stored

JOB_TYPE = "array<struct<title:string,url:string>>"


def page_index(pages: DataFrame) -> DataFrame:
    """Pages keyed by normalised URL, one page per key (lowest ``page_id``): (key, page_id).

    A page without content counts as a miss, as a failed fetch would."""
    keyed = pages.where(F.length(F.btrim("html")) > 0).select(normalize_url("url").alias("key"), "page_id")
    return keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))


def fetch(urls: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Attach ``page_id`` of the snapshot page for each requested URL; misses are dropped."""
    idx = page_index(pages)
    return urls.withColumn("_key", normalize_url(url_col)).join(idx, F.col("_key") == idx["key"]).drop("_key", "key")


def allow_urls(urls: DataFrame, rules: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """Keep URLs an agent may crawl under a rules table ``(domain, agent, ord, allow, prefix)``.

    The rule group is the first agent (by ``ord``) whose name occurs in the agent's product
    token, else ``*``; the first rule of that group whose prefix starts the URL's path (with
    query) decides; no rules for the domain, or no matching rule, allows.

    A path meets rules by equality: it is cut to each of the lengths that its domain's rules have, and the cut is the join key. So the work
    follows the URLs and the different lengths, not the pairs of URLs and rules of a domain.
    """
    token = agent.split("/")[0].lower()
    r = rules.withColumn("_prio", F.when(F.col("agent") == "*", 1)
                         .when(F.lit(token).contains(F.lower("agent")), 0))
    r = r.where(F.col("_prio").isNotNull())
    group = r.groupBy(F.col("domain").alias("_domain")).agg(
        F.min(F.struct("_prio", "ord", "agent")).alias("_g")).select("_domain", F.col("_g.agent").alias("agent"))
    chosen = r.withColumnRenamed("domain", "_domain").join(group, ["_domain", "agent"])
    # Of equal prefixes the first rule decides.
    chosen = chosen.groupBy("_domain", "prefix").agg(F.min(F.struct("ord", "allow")).alias("_rule"))
    lengths = chosen.groupBy("_domain").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    # Each distinct URL is judged once; the verdict joins back on the URL.
    u = urls.select(url_col).distinct()
    path = url_path(url_col)
    q = F.regexp_extract(F.col(url_col), r"^[^?#]*\?([^#]*)", 1)
    target = F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    u = u.withColumn("_domain", netloc(url_col)).withColumn("_path", target)
    cuts = u.join(lengths, "_domain").select(url_col, "_domain", "_path", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.length("_path"))
    cuts = cuts.select(url_col, "_domain", F.substring(F.col("_path"), F.lit(1), F.col("_n")).alias("prefix"))
    verdict = cuts.join(chosen, ["_domain", "prefix"]).groupBy(url_col).agg(F.min("_rule")["allow"].alias("_allow"))
    return urls.join(verdict.where(~F.col("_allow")), url_col, "left_anti")


class CrawlPolicy(NamedTuple):
    """The allow-list that every fetch of a crawl obeys: a rules table (see ``allow_urls``) and the agent's name."""

    rules: DataFrame
    agent: str


def allowed(urls: DataFrame, policy: CrawlPolicy | None, url_col: str = "url") -> DataFrame:
    return urls if policy is None else allow_urls(urls, policy.rules, policy.agent, url_col)


def requests(urls: DataFrame, index: DataFrame, policy: CrawlPolicy | None = None, url_col: str = "url") -> DataFrame:
    """Rows of ``urls`` that the policy allows and the page index knows, with their ``page_id``. No page body takes part.

    The key is a column of its own: expressions with lambdas must not be join keys, since the driver may evaluate the keys of several broadcasts
    at once and lambda variables are shared between copies of a plan.
    """
    return allowed(urls, policy, url_col).withColumn("key", normalize_url(url_col)).join(index, "key").drop("key")


#: Hash buckets of page ids that a crawl step asks for: what is broadcast is bounded by this number, whatever is asked for.
PAGE_BUCKETS = 1 << 20


def pages_where_read(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of ``hits`` (page_id), and those that share a hash bucket with one, filtered by the task that reads them.

    Bodies are neither shuffled nor written: what is extracted from these pages is narrow, and is joined with ``hits`` on ``page_id`` afterwards.
    """
    bucket = lambda: F.pmod(F.xxhash64("page_id"), F.lit(PAGE_BUCKETS)).alias("_bucket")
    wanted = hits.select(bucket()).distinct()
    return pages.select("*", bucket()).join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")


def page_features(pages: DataFrame) -> dict[str, DataFrame]:
    """Page-local extraction in one map-only pass over the pages, written once; ``html`` is not shuffled.

    ``index`` (key, page_id), ``anchors``, ``texts`` (page_id, title, whether the body has a hiring phrase), ``ld``.
    A page without content counts as a miss.
    """
    parts = X.page_text(pages, "url", X.anchor_tags("_shown").alias("anchor_tags"), X.ld_scripts("html").alias("ld_scripts"),
                        has_content=True)
    parts = stored(parts.select("page_id", normalize_url("url").alias("key"), "title",
                                P.has_career_phrase("body", collapsed=True).alias("phrase"), "anchor_tags", "ld_scripts"), "page-parts")
    idx = stored(parts.groupBy("key").agg(F.min("page_id").alias("page_id")), "page-index")
    # Pages that the index doesn't name are parsed too: to leave them out, the tags of all pages would be shuffled.
    return {"index": idx,
            "anchors": stored(X.parse_anchors(parts, "anchor_tags", ["page_id"]), "page-anchors"),
            "texts": parts.select("page_id", "title", "phrase"),
            "ld": stored(X.parse_ld(parts, "ld_scripts"), "page-ld")}


def career_pages(homes: DataFrame, feats: dict[str, DataFrame], policy: CrawlPolicy | None = None) -> DataFrame:
    """W3 (+X3, F13, F10, J3): first valid career page per home URL.

    ``homes``: (home, home_domain). Stage 0 = related career links of the homepage in link
    order; stage 1 = the common paths in order. Returns (home, career_page_url).
    """
    idx = feats["index"]
    hp = stored(requests(homes, idx, policy, "home").select("home", "home_domain", F.col("page_id").alias("hp_id")), "home-requests")
    a = feats["anchors"].where(F.col("href") != "")
    blob = F.lower(F.concat_ws(" ", "text", "title", "aria_label", "href"))
    a = a.where(P.has_career_keyword(blob)).select(F.col("page_id").alias("hp_id"), "pos", "href")
    s0 = with_absolute(hp.join(a, "hp_id"), "absolute", F.col("home"), F.col("href"))
    s0 = s0.groupBy("home", "home_domain", "absolute").agg(F.min("pos").alias("pos"))
    s0 = s0.where(P.is_related_domain(F.col("home_domain"), F.col("absolute"))).select(
        "home", F.lit(0).alias("stage"), "pos", normalize_url("absolute").alias("cand"))
    paths = F.array(*[F.lit(p.lstrip("/")) for p in COMMON_CAREER_PATHS])
    s1 = with_absolute(hp.select("home", F.lit(1).alias("stage"), F.posexplode(paths).alias("pos", "p")),
                       "cand", F.concat("home", F.lit("/")), F.col("p")).select("home", "stage", "pos", "cand")
    cands = stored(s0.unionByName(s1), "career-candidates")
    fetched = requests(cands, idx, policy, "cand")
    valid = fetched.join(feats["texts"], "page_id").where(P.is_career_page("cand", "title", F.col("phrase")))
    return valid.groupBy("home").agg(F.min_by("cand", F.struct("stage", "pos")).alias("career_page_url"))


def company_jobs(sites: DataFrame, feats: dict[str, DataFrame], cap: int | None = None, policy: CrawlPolicy | None = None) -> DataFrame:
    """W4 (+X13, X15, F11, F12): jobs per (career_page_url, company_domain).

    JSON-LD postings first (walk order), then job links (link order); first-wins on
    lower(url) (or lower(title)) across both; all of them, or the first ``cap``.
    """
    idx = feats["index"]
    cp = stored(requests(sites, idx, policy, "career_page_url").select(
        "career_page_url", "company_domain", F.col("page_id").alias("cp_id")), "site-requests")
    ld = feats["ld"].join(cp.select(F.col("cp_id").alias("page_id")).distinct(), "page_id", "left_semi")
    posts = X.job_postings(ld).select(F.col("page_id").alias("cp_id"), F.lit(0).alias("stage"), "path", "title", "url")
    s0 = cp.join(posts, "cp_id").withColumn("key", F.lower(ustrip("url")))
    a = feats["anchors"].where(F.col("href") != "").select(
        F.col("page_id").alias("cp_id"), "pos", "href", F.col("text").alias("title"))
    s1 = with_absolute(cp.join(a, "cp_id"), "url", F.col("career_page_url"), F.col("href"))
    s1 = s1.where((F.col("title") != "") & P.is_job_link(F.col("title"), F.col("url"))
                  & P.is_job_domain(F.col("company_domain"), F.col("url")))
    s1 = s1.select("career_page_url", "company_domain", "cp_id", F.lit(1).alias("stage"), F.array("pos").alias("path"),
                   "title", "url", F.lower("url").alias("key"))
    allj = s0.unionByName(s1).where(F.col("key") != "")
    o = F.struct("stage", "path")
    g = ["career_page_url", "company_domain"]
    first = allj.groupBy(*g, "key").agg(F.min_by(F.struct("title", "url"), o).alias("job"), F.min(o).alias("o"))
    ranked = first if cap is None else first.withColumn("n", F.row_number().over(Window.partitionBy(*g).orderBy("o"))).where(F.col("n") <= cap)
    return ranked.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("o", "job"))).alias("js")).select(
        *g, F.transform("js", lambda x: x["job"]).alias("jobs"))


def enrich(candidates: DataFrame, pages: DataFrame, policy: CrawlPolicy | None = None) -> DataFrame:
    """Q6: candidates with a valid website and a findable career page, plus their jobs.

    Adds ``career_page_url`` and ``jobs``; candidates without a career page are dropped.
    """
    feats = page_features(pages)
    w = ustrip(F.coalesce(F.col("website"), F.lit("")))
    # Career page and jobs are found anew. Every step below is written once, since the next ones read it more than once.
    c = settled(candidates.drop("career_page_url", "jobs"), _w=w).where((F.col("_w") != "") & P.is_valid_website(F.col("_w")))
    c = c.withColumn("_home", ensure_scheme(normalize_url("_w"))).withColumn(
        "_company_domain", F.lower(netloc(ensure_scheme(F.col("_w")))))
    c = stored(c.drop("_w"), "candidates")
    homes = c.select(F.col("_home").alias("home")).distinct().withColumn("home_domain", F.lower(netloc("home")))
    careers = career_pages(homes, feats, policy)
    c = stored(c.join(careers.withColumnRenamed("home", "_home"), "_home"), "with-careers")
    sites = c.select("career_page_url", F.col("_company_domain").alias("company_domain")).distinct()
    jobs = company_jobs(sites, feats, policy=policy)
    out = c.join(jobs.withColumnRenamed("company_domain", "_company_domain"), ["career_page_url", "_company_domain"], "left")
    out = out.withColumn("jobs", F.coalesce(F.col("jobs"), F.array().cast(JOB_TYPE)))
    return out.drop("_home", "_company_domain")
