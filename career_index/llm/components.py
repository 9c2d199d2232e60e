"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a partial ``min`` per node and a join back; links never leave the executors. The
number of rounds is logarithmic in practice, so a long chain takes few rounds. A hub is combined map-side
before the shuffle and its join rows can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import materialize, release


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _stamp(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long); the root is the smallest node of its component.

    Raises if ``max_rounds`` rounds don't settle the links; it never returns unfinished roots.
    """
    links = materialize(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "links")
    before = _stamp(links)
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(links)), "links")
        stamp = _stamp(after)
        release(links)
        links = after
        if stamp == before:
            break
        before = stamp
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
