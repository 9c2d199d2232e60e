"""Enrichment reads its candidates and each of its steps once, in small plans; expressions on pages and links are not written out again and again."""

import re

from pyspark.sql import functions as F

from career_index.functions.urls import resolve_url, with_absolute
from career_index.operators import extract as X
from career_index.operators.enrich import enrich

PAGES = [(1, "https://a.example.com/", '<a href="/careers">Careers</a>'),
         (2, "https://a.example.com/careers", '<title>Jobs</title><script type="application/ld+json">{"@type": "JobPosting", "title": "T", "url": "https://a.example.com/jobs/1"}</script>'
                                              '<a href="/jobs/2">Open position &amp; more</a><a href="jobs/../jobs/2/#x">Open position again</a><a href="/about">About</a>'),
         (3, "https://a.example.com/careers#again", "<p>open positions</p>"), (4, "https://b.example.com", "<p>nothing</p>")]
CANDIDATES = [("A", "a.example.com"), ("A too", "https://a.example.com/"), ("B", "https://b.example.com"), ("none", ""), ("null", None)]


def _enriched(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(name):
        seen.add(1)
        return name
    rows = spark.createDataFrame(CANDIDATES, "name string, website string").withColumn("name", F.udf(count, "string").asNondeterministic()("name"))
    rows = rows.withColumns({"jobs": F.array().cast("array<struct<title:string,url:string>>"), "career_page_url": F.lit("old")})
    return enrich(rows, spark.createDataFrame(PAGES, "page_id long, url string, html string")), seen


def test_candidates_are_read_once(spark):
    out, seen = _enriched(spark)
    got = {r.name: (r.career_page_url, [tuple(j) for j in r.jobs]) for r in out.collect()}
    jobs = [("T", "https://a.example.com/jobs/1"), ("Open position & more", "https://a.example.com/jobs/2")]
    assert got == {"A": ("https://a.example.com/careers", jobs), "A too": ("https://a.example.com/careers", jobs)}
    assert seen.value <= len(CANDIDATES)


def test_last_plan_is_small(spark):
    out, _ = _enriched(spark)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan ExistingRDD", plan)) <= 6
    assert len(plan) < 200_000


def test_nothing_is_written_out_twice(spark):
    assert str(X.elements("html", X.with_class("v"))).count("array_position") == 1
    assert str(X.attr("tag", "href")).count("regexp_extract(x") <= str(X.decode_entities(F.col("tag"))).count("regexp_extract(x") + 1
    links = spark.createDataFrame([("https://a.b/c/", "../d")], "b string, h string")
    plan = with_absolute(links, "u", F.col("b"), F.col("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 20


def test_links_are_resolved_alike_in_both_forms(spark):
    rows = [(b, h) for b in ("https://a.b/c/d?q#f", "http://h", "", None, "rel/x") for h in
            ("", None, "x", "/x/", "../y/./z/", "?", "?p", "#f", "//h/p", "HTTPS://A.B/#", "mailto:m", "https://a.b?x?", " /s\t", "..", "a//b", ".hidden", "http:rel")]
    df = spark.createDataFrame(rows, "b string, h string")
    from career_index.functions.urls import normalize_url
    for r in with_absolute(df.withColumn("whole", normalize_url(resolve_url("b", "h"))), "steps", F.col("b"), F.col("h")).collect():
        assert r.steps == r.whole, r
