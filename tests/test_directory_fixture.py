"""The directory crawl reaches the listing page of every customer."""

from career_index.operators.directory import crawl_directory
from career_index.sources import sites
from career_index.storage import stored

SF = "/root/testdata/sf0.001"


def test_crawl_reaches_every_customer(spark):
    pages = stored(sites.directory_pages(spark, SF), "directory")
    got = {r.source_url for r in crawl_directory(pages, sites.DIRECTORY_ROOT).collect()}
    keys = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 13 <> 0").collect()]  # the others have no website
    assert got == {f"{sites.DIRECTORY_ROOT}listing/c{k}" for k in keys}
