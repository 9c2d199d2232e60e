"""Rows of given ranks, without sorting or writing the whole result.

Bounds around the wanted ranks are taken from a bounded sample of sort keys and checked by exact counts; they close in until few rows lie between
them, and only those are sorted. Each step reads the rows twice (sample, counts) and moves nothing but the sample, so a page deep inside the result
costs a few scans, and the first or last page fewer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sort key: an expression, and whether it is descending. Nulls come first in ascending and last in descending order, as in ``orderBy``.
Key = tuple[Column, bool]


def sort_columns(keys: list[Key]) -> list[Column]:
    return [c.desc() if down else c.asc() for c, down in keys]


def _before(keys: list[Key], bound: list[Column]) -> Column:
    """Whether a row comes strictly before ``bound``, a row of key values."""
    out = F.lit(False)
    for (c, down), v in reversed(list(zip(keys, bound, strict=True))):
        first = (c > v) | (c.isNotNull() & v.isNull()) if down else (c < v) | (c.isNull() & v.isNotNull())
        out = F.coalesce(first, F.lit(False)) | (c.eqNullSafe(v) & out)
    return out


class Bounds:
    """Rows between two bounds: those before ``high`` and not before ``low``; ``below`` rows come before ``low``."""

    def __init__(self, rows: DataFrame, keys: list[Key], size: int):
        self.rows, self.keys, self.size, self.below = rows, keys, size, 0
        self.low = self.high = None

    def frame(self) -> DataFrame:
        out = self.rows
        if self.low is not None:
            out = out.where(~_before(self.keys, self.low))
        return out if self.high is None else out.where(_before(self.keys, self.high))

    def _sample(self, names: list[str], wanted: int, salt: int) -> list:
        every = max(self.size // wanted, 1)
        drawn = self.frame().where(F.pmod(F.xxhash64(F.lit(salt), *names), F.lit(every)) == 0).select(*names)
        # Only the number of sampled keys is bounded here; whatever they are, the counts decide.
        return drawn.limit(4 * wanted).orderBy(*sort_columns(self.keys)).collect()

    def close_in(self, names: list[str], first: int, last: int, wanted: int, salt: int) -> None:
        """Move the bounds towards the ranks ``first`` to ``last``; they never pass them."""
        sample = self._sample(names, wanted, salt)
        if not sample:
            return
        at = [(r - self.below) / self.size * len(sample) for r in (first - 1, last)]
        slack = 3 * math.sqrt(max(len(sample) / 4 - (at[0] - len(sample) / 2) ** 2 / len(sample), 1)) + 2
        left, right = math.floor(at[0] - slack), math.ceil(at[1] + slack)
        types = [self.rows.schema[n].dataType for n in names]
        bound = lambda k: [F.lit(v).cast(t) for v, t in zip(sample[k], types, strict=True)] if 0 <= k < len(sample) else None
        low, high = bound(left), bound(right)
        count = lambda b, missing: F.coalesce(F.sum(_before(self.keys, b).cast("long")), F.lit(0)) if b is not None else F.lit(missing)
        under, upto = self.frame().agg(count(low, 0).cast("long"), count(high, self.size).cast("long")).first()
        below, top = self.below, self.below + self.size
        if high is not None and last <= below + upto:
            self.high, top = high, below + upto
        if low is not None and below + under < first:
            self.low, self.below = low, below + under
        self.size = top - self.below


def narrowed(df: DataFrame, keys: list[Key], first: int, last: int, total: int, window_rows: int = 50_000, sample_rows: int = 4096,
             max_steps: int = 64) -> tuple[Bounds, list[str]]:
    """Bounds with at most ``window_rows`` rows (and the page's own) between them that hold the ranks ``first`` to ``last``."""
    keys = [k if isinstance(k, tuple) else (k, False) for k in keys]  # a bare column is ascending
    names = [f"_key{k}" for k in range(len(keys))]
    rows = df.select("*", *[c.alias(n) for (c, _), n in zip(keys, names, strict=True)])
    found = Bounds(rows, [(F.col(n), down) for n, (_, down) in zip(names, keys, strict=True)], total)
    for step in range(max_steps):
        if found.size <= max(window_rows, 2 * (last - first + 1)):
            return found, names
        found.close_in(names, first, last, sample_rows, step)
    raise RuntimeError(f"no bounds with {window_rows} rows in {max_steps} steps; is the order total?")


def rows_of_ranks(df: DataFrame, keys: list[Key], first: int, last: int, total: int, rank_col: str = "rank", **bounds) -> DataFrame:
    """The rows of ``df`` (``total`` rows) whose ranks in the total order ``keys`` are ``first`` to ``last``, with their rank."""
    found, names = narrowed(df, keys, first, last, total, **bounds)
    order = sort_columns(found.keys)
    taken = found.frame().orderBy(*order).offset(first - 1 - found.below).limit(max(last - first + 1, 0))
    # One page of rows.
    return taken.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long") + (first - 1)).drop(*names)
