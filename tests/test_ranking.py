"""Ranks and pages over several partitions."""

import pytest
from pyspark.sql import functions as F

from career_index.operators.query import page
from career_index.operators.ranking import with_rank

N = 200_000


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_are_complete_and_in_order(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(N).select(F.xxhash64("id").alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("payload"))
        ranked = with_rank(rows, F.col("key"))
        count, distinct, low, high = ranked.agg(F.count("rank"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
        assert (count, distinct, low, high) == (N, N, 1, N)
        keys = [r.key for r in ranked.select("key", "rank").orderBy("rank").collect()]
        assert keys == sorted(keys)
        last = page(rows, [F.col("key")], 10 ** 9)
        assert [r.key for r in last.orderBy("rank").collect()] == keys[-10:]
        assert "SinglePartition" not in last._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
