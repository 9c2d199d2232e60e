"""API-level queries over the served company table (Q1-Q3, Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.constants import PAGE_SIZE
from career_index.functions.urls import apply_url
from career_index.operators import query as q
from career_index.operators.ranking import with_rank
from career_index.operators.selection import sort_columns


def companies(df: DataFrame, country=None, source=None, company=None, jobs_query=None, has_jobs=None,
              sort_by: str = "company", sort_order: str = "asc", rank: bool = True) -> DataFrame:
    """Q1: filter (F4, F5, F6) then stable sort (O2). Arguments are validated eagerly."""
    q.company_sort_key(sort_by)
    q._check(sort_order, ("asc", "desc"), "sort_order")
    df = q.filter_companies(df, country, source, company)
    df = q.filter_has_jobs(df, has_jobs)
    df = q.filter_jobs_query(df, jobs_query)
    return q.sort_companies(df, sort_by, sort_order, rank=rank)


def jobs(df: DataFrame, query=None, country=None, source=None, company=None,
         sort_by: str = "company", sort_order: str = "asc", rank: bool = True) -> DataFrame:
    """Q2: companies filtered (F4, has jobs) before flattening (N1), then stable sort (O3)."""
    q._check(sort_by, q.JOB_SORTS, "sort_by")
    q._check(sort_order, ("asc", "desc"), "sort_order")
    df = q.filter_companies(df, country, source, company)
    df = q.filter_has_jobs(df, True)
    rows = q.job_rows(df, query)
    return q.sort_jobs(rows, sort_by, sort_order, rank=rank)


def stats(df: DataFrame) -> DataFrame:
    """Q3."""
    return q.stats(df)


def feed(df: DataFrame, countries=(), sources=(), companies=(), job_boxes=("with_jobs",), text=None,
         sort_by: str = "company", sort_order: str = "asc", page_number: int | None = 1,
         size: int = PAGE_SIZE) -> DataFrame:
    """Q5: facets (F7) and text (F8) -> display sort (O4) -> job cards (N2) with flag code
    and apply link (P14) -> one page (O5). ``page_number=None`` returns all cards, ranked."""
    keys = [*q.display_keys(sort_by, sort_order), (F.col("pos"), False)]
    vis = q.filter_text(q.filter_facets(df, countries, sources, companies, job_boxes), text)
    cards = q.job_cards(vis)
    cards = q.with_country_iso(cards).withColumn("apply_url", apply_url("url", "career_page_url"))
    named = cards.withColumnRenamed("company_name", "name")
    if page_number is None:
        out = with_rank(named, *sort_columns(keys))
    else:
        out = q.page(named, keys, page_number, size)
    return out.withColumnRenamed("name", "company_name")
