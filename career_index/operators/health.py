"""Source counts and pipeline health (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.constants import SOURCES
from career_index.functions.text import ustrip


def source_counts(df: DataFrame) -> DataFrame:
    """A1: rows per source (blank -> ``unknown``), sorted by source."""
    s = ustrip(F.coalesce(F.col("source"), F.lit("")))
    return df.groupBy(F.when(s == "", F.lit("unknown")).otherwise(s).alias("source")).agg(
        F.count(F.lit(1)).alias("count")).orderBy("source")


def source_count_map(df: DataFrame) -> DataFrame:
    """A1 as one row with a sorted ``map<source, count>``."""
    c = source_counts(df)
    return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count")))).alias("final_by_source"))


def health(raw: DataFrame, deduped: DataFrame, enriched: DataFrame, merged: DataFrame) -> DataFrame:
    """A2: one row: raw candidates per source (all five listed, 0 when absent), totals,
    enriched count, merged count and merged counts by source. Each input is reduced to a
    one-row aggregate first, so the final combination joins single rows only."""
    per = raw.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    row = per.agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).cast("long").alias(s)
                    for s in SOURCES],
                  F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_raw"))
    d = deduped.agg(F.count(F.lit(1)).alias("total_deduped"))
    e = enriched.agg(F.count(F.lit(1)).alias("enriched_with_careers"))
    m = merged.agg(F.count(F.lit(1)).alias("final_merged"))
    by = source_count_map(merged)
    one = row.crossJoin(d).crossJoin(e).crossJoin(m).crossJoin(by)  # five single-row aggregates
    return one.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("generated_at_utc"),
        F.struct(*[F.col(s) for s in SOURCES], F.col("total_raw"), F.col("total_deduped")).alias("candidates"),
        "enriched_with_careers", "final_merged",
        F.coalesce(F.col("final_by_source"), F.create_map().cast("map<string,bigint>")).alias("final_by_source"))
