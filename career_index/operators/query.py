"""Read-side operators over the served company table.

The served table has the final columns plus ``ord`` (internal tie-break: global order of the
record that created the row's list position). Its base order is ``(lower(name), ord)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from career_index.constants import COUNTRY_ISO, PAGE_SIZE, UNTITLED_ROLE
from career_index.functions.text import contains_folded, fold, ustrip
from career_index.operators.ranking import with_rank
from career_index.operators.selection import Key, rows_of_ranks, sort_columns

COMPANY_SORTS = {"company": "name", "country": "country_of_origin", "source": "source", "jobs_count": None}
JOB_SORTS = {"company": "company_name", "country": "country_of_origin", "source": "source", "title": "title"}
JOB_ROW_COLUMNS = ("company_name", "company_website", "country_of_origin", "source", "career_page_url",
                   "title", "url")


def _check(value, allowed, what):
    if value not in allowed:
        raise ValueError(f"{what} must be one of {sorted(allowed)}, got {value!r}")


def jobs_count(jobs="jobs") -> Column:
    """A5: number of jobs (0 for a missing array)."""
    return F.size(F.coalesce(F.col(jobs) if isinstance(jobs, str) else jobs, F.array()))


def base_order() -> list[Column]:
    """O1: lower(name), then list position."""
    return [F.lower("name").asc(), F.col("ord").asc()]


def filter_companies(df: DataFrame, country=None, source=None, company=None) -> DataFrame:
    """case-folded partial matches; each filter is skipped when empty."""
    if country:
        df = df.where(contains_folded("country_of_origin", country))
    if source:
        df = df.where(contains_folded("source", source))
    if company:
        df = df.where(contains_folded("name", company))
    return df


def filter_has_jobs(df: DataFrame, flag: bool | None) -> DataFrame:
    """None keeps all, True keeps companies with jobs, False those without."""
    if flag is True:
        return df.where(jobs_count() > 0)
    if flag is False:
        return df.where(jobs_count() == 0)
    return df


def filter_jobs_query(df: DataFrame, term: str | None) -> DataFrame:
    """keep a company if any job title or URL contains the term (case-folded); jobs unpruned."""
    if not term:
        return df
    t = fold(F.lit(term))
    return df.where(F.exists(F.coalesce(F.col("jobs"), F.array()),
                             lambda j: fold(F.coalesce(j["title"], F.lit(""))).contains(t)
                             | fold(F.coalesce(j["url"], F.lit(""))).contains(t)))


def filter_facets(df: DataFrame, countries=(), sources=(), companies=(), job_boxes=("with_jobs",)) -> DataFrame:
    """exact membership per facet; the job box filter applies only when exactly one is ticked."""
    if countries:
        df = df.where(F.col("country_of_origin").isin(list(countries)))
    if sources:
        df = df.where(F.col("source").isin(list(sources)))
    if companies:
        df = df.where(F.col("name").isin(list(companies)))
    boxes = list(job_boxes or ())
    if len(boxes) == 1:
        if boxes[0] == "with_jobs":
            df = df.where(jobs_count() > 0)
        elif boxes[0] == "without_jobs":
            df = df.where(jobs_count() == 0)
    return df


def filter_text(df: DataFrame, term: str | None) -> DataFrame:
    """F8: trimmed, lower-cased term in name, country, source, or any job title / URL."""
    q = (term or "").strip().lower()
    if not q:
        return df
    jobs = F.coalesce(F.col("jobs"), F.array())
    return df.where(F.lower("name").contains(q) | F.lower("country_of_origin").contains(q)
                    | F.lower("source").contains(q)
                    | F.exists(jobs, lambda j: F.lower(F.coalesce(j["title"], F.lit(""))).contains(q)
                               | F.lower(F.coalesce(j["url"], F.lit(""))).contains(q)))


def company_sort_key(by: str) -> Column:
    _check(by, COMPANY_SORTS, "sort_by")
    if by == "jobs_count":
        return jobs_count()
    return fold(COMPANY_SORTS[by])


def sort_companies(df: DataFrame, by: str = "company", order: str = "asc", rank: bool = True) -> DataFrame:
    """O2: stable sort both ways; ties keep the base order."""
    _check(order, ("asc", "desc"), "sort_order")
    key = company_sort_key(by)
    cols = [key.desc() if order == "desc" else key.asc(), *base_order()]
    return with_rank(df, *cols) if rank else df.orderBy(*cols)


def job_rows(df: DataFrame, query: str | None = None) -> DataFrame:
    """One row per job with a non-blank title and URL; optional case-folded term filter.

    Company columns are projected first so ``html``-free narrow rows are exploded.
    """
    rows = df.select("name", "website", "country_of_origin", "source", "career_page_url", "ord",
                     F.posexplode(F.coalesce(F.col("jobs"), F.array())).alias("pos", "job"))
    rows = rows.select(
        F.col("name").alias("company_name"), F.col("website").alias("company_website"),
        "country_of_origin", "source", "career_page_url",
        ustrip(F.coalesce(F.col("job.title"), F.lit(""))).alias("title"),
        ustrip(F.coalesce(F.col("job.url"), F.lit(""))).alias("url"), "ord", "pos")
    rows = rows.where((F.col("title") != "") & (F.col("url") != ""))
    if query:
        rows = rows.where(contains_folded("title", query) | contains_folded("url", query))
    return rows


def sort_jobs(rows: DataFrame, by: str = "company", order: str = "asc", rank: bool = True) -> DataFrame:
    """O3: stable sort of job rows; ties keep (company base order, job position)."""
    _check(by, JOB_SORTS, "sort_by")
    _check(order, ("asc", "desc"), "sort_order")
    key = fold(JOB_SORTS[by])
    cols = [key.desc() if order == "desc" else key.asc(), F.lower("company_name").asc(), F.col("ord").asc(),
            F.col("pos").asc()]
    return with_rank(rows, *cols) if rank else rows.orderBy(*cols)


def display_keys(by: str = "company", order: str = "asc") -> list[Key]:
    """Locale-aware sort, then the whole list reversed for desc (ties reverse too)."""
    _check(by, COMPANY_SORTS, "sort_by")
    _check(order, ("asc", "desc"), "sort_order")
    if by == "jobs_count":
        key = jobs_count()
    else:
        key = F.collate(F.col(COMPANY_SORTS[by]), "UNICODE")
    return [(c, order == "desc") for c in (key, F.lower("name"), F.col("ord"))]


def display_order(by: str = "company", order: str = "asc") -> list[Column]:
    return sort_columns(display_keys(by, order))


def sort_display(df: DataFrame, by: str = "company", order: str = "asc", rank: bool = True) -> DataFrame:
    cols = display_order(by, order)
    return with_rank(df, *cols) if rank else df.orderBy(*cols)


def job_cards(df: DataFrame) -> DataFrame:
    """One card per job, blanks kept: ``Untitled role``, empty URL, ``key = name::(url or title)``."""
    rows = df.select("name", "website", "career_page_url", "country_of_origin", "source", "ord",
                     F.posexplode(F.coalesce(F.col("jobs"), F.array())).alias("pos", "job"))
    t = F.coalesce(F.col("job.title"), F.lit(""))
    u = F.coalesce(F.col("job.url"), F.lit(""))
    return rows.select(
        F.concat(F.col("name"), F.lit("::"), F.when(u != "", u).otherwise(t)).alias("key"),
        F.when(t != "", t).otherwise(F.lit(UNTITLED_ROLE)).alias("title"),
        u.alias("url"),
        F.col("name").alias("company_name"), F.col("website").alias("company_website"),
        "career_page_url", "country_of_origin", "source", "ord", "pos")


def country_iso_table(spark) -> DataFrame:
    return spark.createDataFrame(list(COUNTRY_ISO), "country_key string, iso string")


def with_country_iso(df: DataFrame, col: str = "country_of_origin", out: str = "country_iso") -> DataFrame:
    """ISO code of lower(trim(country)); unknown -> ``""``. The lookup is a fixed 33-row table."""
    iso = country_iso_table(df.sparkSession)
    keyed = df.withColumn("_ck", F.lower(ustrip(F.coalesce(F.col(col), F.lit("")))))
    j = keyed.join(F.broadcast(iso), keyed["_ck"] == iso["country_key"], "left")
    return j.withColumn(out, F.coalesce(F.col("iso"), F.lit(""))).drop("_ck", "country_key", "iso")


def stats(df: DataFrame) -> DataFrame:
    """A3: companies, companies with jobs, total jobs (0 on an empty table)."""
    n = jobs_count()
    return df.agg(F.count(F.lit(1)).alias("companies_count"),
                  F.coalesce(F.sum(F.when(n > 0, 1).otherwise(0)), F.lit(0)).cast("long")
                  .alias("companies_with_jobs_count"),
                  F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_jobs_count"))


def facet_values(df: DataFrame, column: str, find: str | None = None, rank: bool = True) -> DataFrame:
    """A4: distinct non-empty values in locale order; optional lower-case substring filter."""
    vals = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    q = (find or "").strip().lower()
    if q:
        vals = vals.where(F.lower("value").contains(q))
    cols = [F.collate(F.col("value"), "UNICODE").asc(), F.col("value").asc()]
    return with_rank(vals, *cols) if rank else vals.orderBy(*cols)


def page(df: DataFrame, keys: list[Key], page_number: int = 1, size: int = PAGE_SIZE, **bounds) -> DataFrame:
    """One page of ``size`` rows; the page is clamped to [1, max(1, ceil(n / size))].

    ``df`` is read a few times, so it should be a stored table or cheap to derive. Only the rows around the page are sorted, and none are written.
    """
    n = df.count()
    p = min(max(1, int(page_number)), max(1, math.ceil(n / size)))
    start = (p - 1) * size
    return rows_of_ranks(df, keys, start + 1, min(start + size, n), n, **bounds).withColumn("page", F.lit(p))
