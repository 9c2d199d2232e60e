"""Connected components by contraction.

In every round each node hooks to the neighbour that comes first in a random order (a hash salted by the round), pointers are doubled, and the
edges between what is left form a smaller graph. A round removes a constant share of the nodes whatever the shape (about two thirds of a chain), so
the rounds are logarithmic and the tables shrink geometrically. The maps of all rounds are then composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.storage import release, stored


def _hooked(edges: DataFrame, salt: int) -> DataFrame:
    """(node, up): every node with itself or the neighbour that comes first in the round's order. A hub is combined map-side."""
    place = lambda c: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("id"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min(place("v")).alias("m"))
    return first.select(F.col("u").alias("node"), F.least(F.col("m"), place("u"))["id"].alias("up"))


def _jump(up: DataFrame) -> DataFrame:
    return up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) that has an edge to another node; nodes are connected if and only if their roots are equal.

    Raises if ``max_rounds`` rounds leave edges.
    """
    left = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    maps = []
    while not left.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        once = stored(_hooked(left, len(maps)), "hooks")
        twice = stored(_jump(once), "hooks")
        up = stored(_jump(twice), "hooks")
        release(once, twice)
        maps.append(up)
        end = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        moved = left.join(end("u"), "u").join(end("v"), "v").select(F.least("u_up", "v_up").alias("u"), F.greatest("u_up", "v_up").alias("v"))
        after = stored(moved.filter("u < v").distinct(), "edges")
        release(left)
        left = after
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1].withColumnRenamed("up", "root")
    for up in reversed(maps[:-1]):
        rest = out.select(F.col("node").alias("up"), F.col("root").alias("last"))
        out = up.join(rest, "up", "left").select("node", F.coalesce("last", "up").alias("root"))
    out = stored(out, "roots")
    out.rounds = len(maps)
    release(left, *maps)
    return out
