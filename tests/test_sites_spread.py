"""The crawl pages are built by many tasks, however small the file of the base table is, and heavy pages aren't left to a few of them."""

from pyspark.sql import functions as F

from career_index.sources import sites


def test_no_task_builds_most_pages(spark, tmp_path):
    spark.createDataFrame([(k, k % 25) for k in range(4000)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 5, f"N{k}") for k in range(25)], "n_nationkey int, n_regionkey int, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    for pages in (sites.company_sites(spark, str(tmp_path)), sites.directory_pages(spark, str(tmp_path)).where("url LIKE '%/listing/%'")):
        size = F.sum(F.length("html"))
        loads = [r.n for r in pages.groupBy(F.spark_partition_id()).agg(size.alias("n")).collect()]
        assert len(loads) >= 4 * spark.sparkContext.defaultParallelism
        assert max(loads) < 0.2 * sum(loads)
    ids = [r.page_id for r in sites.company_sites(spark, str(tmp_path)).collect()]
    assert len(ids) == len(set(ids)) == 4000 * 3 + sum((k % 3 == 0) + (k % 7 in (1, 2)) + (k % 2 == 0) for k in range(4000))
