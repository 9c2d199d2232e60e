"""Global rank of a sorted result without moving all rows into one partition.

``orderBy`` range-partitions and sorts in parallel. The sorted rows are written once, each with the
index of its sorted partition and its place there; sizes and ranks both come from those files, so
they can't disagree. Sizes are one row per partition; their running sum gives the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from career_index.storage import stored

_LOW_BITS = (1 << 33) - 1


def with_rank(df: DataFrame, *order, rank_col: str = "rank") -> DataFrame:
    """Sort by ``order`` (a total order) and add a 1-based ``rank``."""
    mid = F.monotonically_increasing_id()
    s = stored(df.orderBy(*order).withColumn("_mid", mid), "ranked")
    s = s.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    sizes = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per sorted partition, so the single-partition window and the broadcast stay small.
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    out = s.join(F.broadcast(offsets), "_part", "left")
    rank = F.col("_off") + F.col("_idx") + 1
    out = out.withColumn(rank_col, F.when(rank.isNotNull(), rank).otherwise(F.raise_error(F.lit("a row without a rank")).cast("long")))
    return out.drop("_mid", "_part", "_idx", "_off")
