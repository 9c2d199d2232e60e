"""Driver tables (one parquet file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *by: str, rows: int | None = None, rows_per_task: int = 10_000) -> DataFrame:
    """The same rows dealt over enough tasks for work that is heavy per row. A narrow table is a small file, which few tasks read however many rows it has.

    Without ``rows``, an estimate of their number, they are counted. Rows with the same ``by`` stay together."""
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if rows is None else rows) // rows_per_task))
    return df.repartition(tasks, *by)
