"""Unions, orders, snapshots without an order, and the allow-list of a crawl."""

import json
import random

import pytest

from career_index.operators.dedupe import candidate_order, union_lists, union_sources
from career_index.operators.directory import crawl_directory
from career_index.operators.enrich import CrawlPolicy, allow_urls
from career_index.plans.build import resolve
from career_index.sources import sites
from career_index.sources.snapshot import read_companies
from career_index.storage import stored

SF = "/root/testdata/sf0.001"
COMPANY = ("ord long, name string, website string, career_page_url string, country_of_origin string, source string, "
           "jobs array<struct<title:string,url:string>>")


def test_unknown_sources_raise(spark):
    df = spark.range(2).withColumnRenamed("id", "seq")
    with pytest.raises(ValueError, match="elsewhere"):
        union_sources({"clutch": df, "elsewhere": df})
    assert [(r.source_rank, r.seq) for r in union_sources({"clutch": df, "wikipedia": df}).orderBy("source_rank", "seq").collect()] == [(0, 0), (0, 1), (3, 0), (3, 1)]


def test_a_sequence_number_out_of_range_raises(spark):
    df = spark.createDataFrame([(4, 10**15 - 1)], "source_rank int, seq long")
    assert df.select(candidate_order().alias("o")).first().o == 5 * 10**15 - 1
    with pytest.raises(Exception, match="seq must be"):
        spark.createDataFrame([(0, 10**15)], "source_rank int, seq long").select(candidate_order()).collect()


def test_200_lists_keep_their_order(spark):
    lists = [spark.range(2).selectExpr(f"if(id = 0, {10**18 - k}, {k}) AS ord", f"if(id = 0, 'a{k}', 'b{k}') AS name") for k in range(200)]
    got = [r.name for r in union_lists(*lists).orderBy("list_rank", "ord").collect()]
    assert got == [x for k in range(200) for x in (f"b{k}", f"a{k}")]


def test_merged_lists_resolve_in_list_order(spark):
    """Equal orders in different lists: the record of the earlier list opens the place, whatever its number."""
    def company(o, name, host, career):
        return (o, name, f"https://{host}.com", f"https://x.com/{career}", "France", "s", None)
    one = spark.createDataFrame([company(9 * 10**17, "Acme", "a", "cc")], COMPANY)
    two = spark.createDataFrame([company(1, "Acme two", "a", "c"), company(2, "Beta", "b", "c")], COMPANY)
    three = spark.createDataFrame([company(1, "Beta", "b2", "c")], COMPANY)
    got = [(r.ord, r.name) for r in resolve(one, two, three).orderBy("ord").collect()]
    assert got == [(1, "Acme two"), (3, "Beta")]


def test_rows_without_an_order_follow_the_files(spark, tmp_path):
    row = lambda n, **kw: json.dumps({"name": n, "website": "w", "career_page_url": "c", "country_of_origin": "x", "source": "s", "jobs": [], **kw})
    (tmp_path / "a.json").write_text("\n".join(row(f"a{k}") for k in range(40)))
    (tmp_path / "b.json").write_text("\n".join([row("own", ord=70), *[row(f"b{k}") for k in range(40)]]))
    got = read_companies(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.name for r in got] == ["own", *[f"a{k}" for k in range(40)], *[f"b{k}" for k in range(40)]]
    assert [r.ord for r in got] == list(range(70, 151))


def test_allow_list_equals_the_rules_one_by_one(spark):
    rng = random.Random(6)
    part = lambda: "/" + "".join(rng.choice("ab/?") for _ in range(rng.randrange(0, 6)))
    rules = [("h.com", rng.choice(["*", "bot"]), k, rng.random() < 0.5, rng.choice(["", part()])) for k in range(60)]
    rules += [("hub.com", "*", k, k % 2 == 0, f"/p{k}") for k in range(10_000)]
    urls = [f"https://{rng.choice(['h.com', 'free.com'])}{part()}" for _ in range(300)] + [f"https://hub.com/p{k}" for k in range(0, 12_000, 7)]

    def allowed(url):
        host, _, path = url.removeprefix("https://").partition("/")
        path = "/" + path
        own = [r for r in rules if r[0] == host and r[1] == "bot"] or [r for r in rules if r[0] == host]
        hit = next((r for r in sorted(own, key=lambda r: r[2]) if path.startswith(r[4])), None)
        return hit is None or hit[3]

    by_prefix = {f"/p{k}": k for k in range(10_000)}

    def hub_allowed(url):
        path = url.removeprefix("https://hub.com")
        hits = [by_prefix[path[:n]] for n in range(3, len(path) + 1) if path[:n] in by_prefix]
        return not hits or min(hits) % 2 == 0

    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url for r in allow_urls(df, spark.createDataFrame(rules, "domain string, agent string, ord int, allow boolean, prefix string"), "Bot/2").collect()}
    assert got == {u for u in urls if (hub_allowed(u) if "hub.com" in u else allowed(u))}


def test_every_fetch_of_a_crawl_obeys_the_allow_list(spark):
    pages = stored(sites.directory_pages(spark, SF), "directory")
    host = sites.DIRECTORY_ROOT.split("/")[2]
    rules = [(host, "*", 0, False, "/directory/listing/c1"), (host, "*", 1, False, "/directory/wpbdp_category/n3/")]
    policy = CrawlPolicy(spark.createDataFrame(rules, "domain string, agent string, ord int, allow boolean, prefix string"), "CareerIndex/1.0")
    got = {r.source_url for r in crawl_directory(pages, sites.DIRECTORY_ROOT, policy=policy).collect()}
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 13 <> 0 AND c_nationkey <> 3").collect()]
    assert got == {f"{sites.DIRECTORY_ROOT}listing/c{k}" for k in keys if not str(k).startswith("1")}
    blocked = CrawlPolicy(spark.createDataFrame([(host, "*", 0, False, "/")], policy.rules.schema), "CareerIndex/1.0")
    assert crawl_directory(pages, sites.DIRECTORY_ROOT, policy=blocked).count() == 0
