"""Input tables derived from the driver tables with plain SQL expressions.

``raw_candidates`` is one company candidate per ``customer`` row; collisions on name and domain
stay inside blocks of ten customers. The same expressions (``CANDIDATE_COLUMNS``) are rendered
into the DuckDB oracle, so both engines see identical inputs; only the ``jobs`` array builder
differs per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from career_index.sources.tables import spread, table

SOURCE_CASE = ("CASE c_custkey % 5 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'wikipedia_global' "
               "WHEN 2 THEN 'eu_startups' WHEN 3 THEN 'clutch' ELSE 'themanifest' END")

# (alias, SQL expression) over customer columns plus derived ``nid`` / ``did``.
CANDIDATE_COLUMNS = (
    ("source_rank", "CAST(c_custkey % 5 AS INT)"),
    ("seq", "c_custkey"),
    ("source", SOURCE_CASE),
    ("name", "CASE c_custkey % 3 WHEN 0 THEN concat('Company ', CAST(nid AS STRING)) "
             "WHEN 1 THEN concat('COMPANY  ', CAST(nid AS STRING)) "
             "ELSE concat(' company ', CAST(nid AS STRING), ' ') END"),
    ("website", "CASE c_custkey % 8 WHEN 0 THEN concat('https://www.c', CAST(did AS STRING), '.example.com/') "
                "WHEN 1 THEN concat('c', CAST(did AS STRING), '.example.com') "
                "WHEN 2 THEN concat('http://C', CAST(did AS STRING), '.example.com') "
                "WHEN 3 THEN '' WHEN 4 THEN 'nodot' "
                "ELSE concat('https://c', CAST(did AS STRING), '.example.com/about#top') END"),
    ("career_page_url", "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('https://c', CAST(did AS STRING), "
                        "'.example.com/careers', repeat('/x', CAST(c_custkey % 3 AS INT))) END"),
    ("country_of_origin", "CASE c_nationkey % 9 WHEN 0 THEN 'Austria' WHEN 1 THEN 'Belgium' "
                          "WHEN 2 THEN 'France' WHEN 3 THEN 'Germany' WHEN 4 THEN 'United Kingdom' "
                          "WHEN 5 THEN 'United States' WHEN 6 THEN 'Japan' WHEN 7 THEN 'Unknown' ELSE '' END"),
    ("source_url", f"concat('https://lists.example.org/', {SOURCE_CASE}, '/', CAST(c_custkey AS STRING))"),
)

CUSTOMER_KEYS_SQL = ("CAST(floor(c_custkey / 10) AS BIGINT) * 10 + (c_custkey * 7) % 4 AS nid",
                     "CAST(floor(c_custkey / 10) AS BIGINT) * 10 + (c_custkey * 3) % 5 AS did")

JOB_TITLE_SQL = "o_orderpriority"
JOB_URL_SQL = ("concat('https://boards.greenhouse.io/c', CAST(o_custkey AS STRING), '/jobs/', "
               "CAST(o_orderkey % 4 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE '' END)")

JOB_TYPE = "array<struct<title:string,url:string>>"


def candidate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, jobs) with jobs ordered by order key; customers without orders get none."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select("o_custkey", F.struct(F.col("o_orderkey"), F.expr(JOB_TITLE_SQL).alias("title"),
                                                F.expr(JOB_URL_SQL).alias("url")).alias("j"))
    return (items.groupBy("o_custkey")
            .agg(F.array_sort(F.collect_list("j")).alias("js"))
            .select("o_custkey", F.transform("js", lambda j: F.struct(j["title"].alias("title"),
                                                                       j["url"].alias("url"))).alias("jobs")))


def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows: ``source_rank, seq`` give the global order; ``jobs`` as found on career pages."""
    cust = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).selectExpr("*", *CUSTOMER_KEYS_SQL)
    base = cust.selectExpr("c_custkey", *[f"{expr} AS {alias}" for alias, expr in CANDIDATE_COLUMNS])
    jobs = candidate_jobs(spark, sf_dir)
    out = base.join(jobs, base.c_custkey == jobs.o_custkey, "left")
    return out.select(*[a for a, _ in CANDIDATE_COLUMNS],
                      F.coalesce(F.col("jobs"), F.array().cast(JOB_TYPE)).alias("jobs"))


def duckdb_raw_candidates_sql() -> str:
    """The same fixture as a DuckDB subquery."""
    cols = ", ".join(f"{expr} AS {alias}" for alias, expr in CANDIDATE_COLUMNS)
    return (
        "(SELECT " + cols + ", coalesce(j.jobs, []) AS jobs FROM "
        "(SELECT c_custkey, c_nationkey, " + ", ".join(CUSTOMER_KEYS_SQL) + " FROM customer) c "
        "LEFT JOIN (SELECT o_custkey, list({'title': " + JOB_TITLE_SQL + ", 'url': " + JOB_URL_SQL
        + "} ORDER BY o_orderkey) AS jobs FROM orders GROUP BY o_custkey) j "
        "ON j.o_custkey = c.c_custkey)"
    )


ORD_SOURCE_STRIDE = 10 ** 15


def candidates_with_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates plus ``ord`` = source_rank * 10^15 + seq (global order as one long)."""
    rc = raw_candidates(spark, sf_dir)
    return rc.withColumn("ord", F.col("source_rank").cast("long") * F.lit(ORD_SOURCE_STRIDE) + F.col("seq"))


def served_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A served company table built with exact SQL-checkable steps: F2 gate, then first
    record per domain key (W1). Columns: final columns + ``ord``."""
    from career_index.functions.urls import domain_key
    from career_index.operators.dedupe import first_wins
    from career_index.operators.resolve import final_records
    fin = final_records(candidates_with_ord(spark, sf_dir))
    return first_wins(fin, [domain_key("website")], ["ord"])
