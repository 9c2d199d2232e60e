"""Candidate extraction from directory and list sites (X4-X12 compositions, J2, J4, J5, W2, F3, Q8).

``seeds``: (source, list_rank, url). Every crawl step joins its requests with the page index on the normalised
URL, extracts from the requested pages where they are read, and joins the narrow results back on ``page_id``; page bodies never move.
A ``policy`` is applied to the requests of every step. All linked categories, listings and profiles are read;
``max_...`` arguments limit them on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.constants import EUROPE_COUNTRIES
from career_index.functions import predicates as P
from career_index.functions.text import name_key, ustrip
from career_index.functions.urls import normalize_url
from career_index.operators import extract as X
from career_index.operators.dedupe import first_wins, greedy_dedupe
from career_index.operators.enrich import CrawlPolicy, page_index, pages_where_read, requests
from career_index.operators.ranking import with_rank
from career_index.storage import stored

CANDIDATE_COLS = ("source_rank", "seq", "name", "website", "career_page_url", "country_of_origin", "source", "source_url")


def _hits(urls: DataFrame, index: DataFrame, policy: CrawlPolicy | None, url_col: str = "url") -> DataFrame:
    """The requests of one crawl step that are allowed and known, written once: narrow rows with a ``page_id``."""
    return stored(requests(urls, index, policy, url_col), "requests")


def _index(pages: DataFrame, index: DataFrame | None) -> DataFrame:
    return stored(page_index(pages), "page-index") if index is None else index


def _first_k(df: DataFrame, order, k: int | None, rank_col: str) -> DataFrame:
    """All rows ranked by ``order`` from 1, or the first ``k`` of them."""
    ranked = with_rank(df, order, rank_col=rank_col)
    return ranked if k is None else ranked.where(F.col(rank_col) <= k)


def fill_websites(rows: DataFrame, pages: DataFrame, index: DataFrame | None = None, policy: CrawlPolicy | None = None) -> DataFrame:
    """Rows without a website take the article page's website (X7); kept when no page."""
    need = rows.where((F.col("website") == "") & (F.col("company_wiki_url") != "")).select("company_wiki_url").distinct()
    hits = _hits(need, _index(pages, index), policy, "company_wiki_url")
    found = X.infobox_website(pages_where_read(hits, pages).select("page_id", "html")).join(hits, "page_id")
    found = found.groupBy("company_wiki_url").agg(F.min("website").alias("_filled"))
    out = rows.join(found, "company_wiki_url", "left")
    return out.withColumn("website", F.when((F.col("website") == "") & F.col("_filled").isNotNull(), F.col("_filled"))
                          .otherwise(F.col("website"))).drop("_filled")


def list_source(pages: DataFrame, seeds: DataFrame, source: str, europe_only: bool = False,
                index: DataFrame | None = None, policy: CrawlPolicy | None = None) -> DataFrame:
    """List-table source: rows of the seed list pages -> J2 -> W2 (-> F3 for the global list)."""
    s = seeds.where(F.col("source") == source).select("list_rank", F.col("url").alias("source_url"))
    index = _index(pages, index)
    hits = _hits(s, index, policy, "source_url")
    rows = stored(X.list_rows(pages_where_read(hits, pages).select("page_id", "html")).join(hits, "page_id"), "list-rows")
    rows = fill_websites(rows, pages, index, policy)
    # Places keep their order as ranks: no width is assumed for tables or rows.
    rows = with_rank(rows, "list_rank", "table_pos", "row_pos", rank_col="seq")
    kept = greedy_dedupe(rows, name_key("name"), F.col("website"), ["seq"])
    if europe_only:
        kept = kept.where(P.is_listed_country(F.col("country"), EUROPE_COUNTRIES))
    return kept.select("seq", "name", "website", F.lit("").alias("career_page_url"),
                       F.col("country").alias("country_of_origin"), F.lit(source).alias("source"), "source_url")


def crawl_directory(pages: DataFrame, root: str, source: str = "eu_startups",
                    max_categories: int | None = None, max_listings: int | None = None,
                    index: DataFrame | None = None, policy: CrawlPolicy | None = None) -> DataFrame:
    """Root -> first categories (in link order) -> first distinct listings -> records -> W1."""
    index = _index(pages, index)

    def page_bodies(hits):
        return pages_where_read(hits, pages).select("page_id", "url", "html")
    r = _hits(pages.sparkSession.createDataFrame([(root,)], "url string"), index, policy)
    cats = X.category_urls(page_bodies(r), root).join(r.select("page_id"), "page_id", "left_semi")
    cats = _first_k(cats, F.col("pos"), max_categories, "cat_rank")
    c = _hits(cats.select("cat_rank", "url"), index, policy)
    lst = X.listing_urls(page_bodies(c), root).join(c.select("page_id", "cat_rank"), "page_id")
    first = lst.groupBy("url").agg(F.min(F.struct("cat_rank", "pos")).alias("o"))
    first = _first_k(first, F.col("o"), max_listings, "n")
    li = _hits(first.select("n", "url"), index, policy)
    recs = X.listing_records(page_bodies(li), source).join(li.select("page_id", "n"), "page_id")
    # Written once: the first of each name is found and then joined with the records, and pages would be read and parsed for both.
    recs = stored(recs.withColumn("seq", F.col("n").cast("long")), "records")
    keys = [F.lower(ustrip("name")), F.lower(ustrip("website"))]
    return first_wins(recs, keys, ["seq"]).select("seq", "name", "website", F.lit("").alias("career_page_url"),
                                                  "country_of_origin", "source", "source_url")


def crawl_profiles(pages: DataFrame, seeds: DataFrame, source: str, host_token: str, marker: str,
                   max_profiles: int | None = None, index: DataFrame | None = None, policy: CrawlPolicy | None = None) -> DataFrame:
    """List pages (challenge pages skipped) -> distinct profile URLs in (list, stage, pos)
    order -> profile pages (challenge pages skipped) -> records (X12) -> W1."""
    s = seeds.where(F.col("source") == source).select("list_rank", "url")
    index = _index(pages, index)

    def page_bodies(hits):
        return pages_where_read(hits, pages).select("page_id", "url", "html").where(~P.is_challenge("html"))
    li = _hits(s, index, policy)
    pu = X.profile_urls(page_bodies(li), host_token, marker).join(li.select("page_id", "list_rank"), "page_id")
    first = pu.groupBy("url").agg(F.min(F.struct("list_rank", "stage", "pos")).alias("o"))
    first = _first_k(first, F.col("o"), max_profiles, "n")
    pr = _hits(first.select("n", "url"), index, policy)
    recs = X.profile_records(page_bodies(pr), source).join(pr.select("page_id", "n"), "page_id")
    # Written once: the first of each name is found and then joined with the records, and pages would be read and parsed for both.
    recs = stored(recs.withColumn("seq", F.col("n").cast("long")), "records")
    keys = [F.lower(ustrip("name")), F.lower(ustrip("website"))]
    return first_wins(recs, keys, ["seq"]).select("seq", "name", "website", F.lit("").alias("career_page_url"),
                                                  "country_of_origin", "source", "source_url")


def build_directory(pages: DataFrame, seeds: DataFrame, directory_root: str, policy: CrawlPolicy | None = None) -> dict[str, DataFrame]:
    """Q8: candidates per source, in source order. One page index serves every fetch of the build."""
    both = {"index": _index(pages, None), "policy": policy}
    seeds = stored(seeds, "seeds")
    return {
        "wikipedia": list_source(pages, seeds, "wikipedia", **both),
        "wikipedia_global": list_source(pages, seeds, "wikipedia_global", europe_only=True, **both),
        "eu_startups": crawl_directory(pages, directory_root, **both),
        "clutch": crawl_profiles(pages, seeds, "clutch", "clutch.co", "profile", **both),
        "themanifest": crawl_profiles(pages, seeds, "themanifest", "themanifest.com", "company", **both),
    }
