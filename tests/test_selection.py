"""Rows of given ranks against a full sort."""

import random

import pytest
from pyspark.sql import functions as F

from career_index.operators.query import page
from career_index.operators.selection import narrowed, rows_of_ranks, sort_columns

SCHEMA = "a string, b long, c long"


def frame(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, "", "a", "B", "b", "Á", "aa", "z"]), rng.choice([None, 0, 1, 2, 3]), i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def keys(down_a, down_b):
    return [(F.collate(F.col("a"), "UNICODE"), down_a), (F.col("b"), down_b), (F.col("c"), False)]


@pytest.mark.parametrize("down_a,down_b", [(False, False), (True, False), (False, True), (True, True)])
def test_ranks_equal_a_full_sort(spark, down_a, down_b):
    df = frame(spark, 3000)
    order = keys(down_a, down_b)
    want = [r.c for r in df.orderBy(*sort_columns(order)).collect()]
    for first, last in ((1, 10), (1491, 1503), (2991, 3000)):
        got = rows_of_ranks(df, order, first, last, 3000, window_rows=60, sample_rows=100).collect()
        assert [(r["rank"], r.c) for r in sorted(got, key=lambda r: r["rank"])] == list(zip(range(first, last + 1), want[first - 1:last], strict=True))
        assert got[0].asDict().keys() == {"a", "b", "c", "rank"}


def test_few_rows_are_sorted(spark):
    """Of 10 million rows the first, the middle and the last page sort less than one in a hundred."""
    n = 10_000_000
    df = spark.range(n).selectExpr("hash(id) AS h", "id")
    order = [(F.col("h"), True), (F.col("id"), False)]
    for first in (1, n // 2, n - 9):
        found, _ = narrowed(df, order, first, first + 9, n)
        assert found.size < n / 100 and found.below < first and first + 9 <= found.below + found.size
    assert df.where(~F.col("h").isNull()).count() == n


def test_pages(spark):
    df = frame(spark, 95)
    order = keys(True, False)
    want = [r.c for r in df.orderBy(*sort_columns(order)).collect()]
    for number, shown, size in ((1, 1, 10), (0, 1, 10), (10, 10, 5), (99, 10, 5)):
        got = sorted(page(df, order, number).collect(), key=lambda r: r["rank"])
        assert [r.c for r in got] == want[(shown - 1) * 10:(shown - 1) * 10 + size]
        assert {r.page for r in got} == {shown}
    assert page(df.limit(0), order, 3).count() == 0


def test_an_order_with_ties_only_raises(spark):
    df = spark.range(5000).selectExpr("1 AS k", "id")
    with pytest.raises(RuntimeError, match="total"):
        narrowed(df, [(F.col("k"), False)], 1, 10, 5000, window_rows=100, sample_rows=50, max_steps=3)
