"""Audit of how filters interact, by the Hart-Mas-Colell potential of the removal game (operator 12).

Five filters may each fail a document. The removal game of a part gives a coalition of filters the number of documents that
fail at least one of them. What a filter removes at a step of an order is the difference of two coalitions: the filters up to it, and those before it.
The potential is defined by recursion over the 32 coalitions,

    |S| P(S) = v(S) + sum of P(S without i) over i in S,   P(empty) = 0,

and the Shapley value of a filter is P(all) - P(all without it). 60 P(S) is always whole (60 is the least common multiple of 1 to 5), so the
recursion runs in whole numbers and the sum over all 120 orders, 120 times the Shapley value, is exact.

Documents are reduced at once to a digest, a part and four failures. Equal rows are combined before any shuffle; the first of equal texts is a
map-side ``min`` per digest, found again by digest and id together, so that a text that a third of all rows share loads no task. Everything
after the count per part and failure pattern has at most 32 rows a part.

Defined results: null text equals empty text; it fails filter A, and filter E if a smaller id has an empty or null text. Null sources are the part "".
A null id is no smaller than any other and has no label. Rows with equal ids don't make each other redundant under E, since neither id is smaller. A document
is good or toxic if any row of ``labels`` with its id says so. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import let, materialize, text_or_empty
from career_index.llm.quality import words

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Least common multiple of the coalition sizes: makes every potential whole.
WHOLE = 60
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda cond, k: F.when(cond, F.lit(1 << k)).otherwise(F.lit(0))
    rest = bit(100 * capitals > 5 * F.length(text), 2) + bit(F.rlike(text, F.lit("[#$%&*|]")), 3)
    return let(words(text), lambda w: bit(F.size(w) < 50, 0) + bit(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 1)) + rest


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(text).alias("fails"))
    rows = materialize(rows.groupBy("id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    # Joined by digest and id, which only first rows share: no text's copies meet in one task.
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "id"], "left")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.join(marks, "id", "left")
    mask = F.col("fails") + F.when(F.col("id").isNotNull() & F.col("first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    flag = lambda name: F.sum(F.when(F.col(name) == 1, F.col("n")).otherwise(F.lit(0)))
    return marked.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic"))


def _total(cells: Column, name: str, test) -> Column:
    return F.aggregate(F.filter(cells, lambda x: test(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + x[name])


def _game(cells: Column, name: str) -> Column:
    """v(S) for S = 0 ... 31: documents that fail a filter of S."""
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: _total(cells, name, lambda m: m.bitwiseAND(s) != 0))


def _potential(game: Column) -> Column:
    """60 P(S) for S = 0 ... 31. Subsets of S are smaller numbers, so one pass in order of S is the recursion."""
    def step(known: Column, s: Column) -> Column:
        parts = F.lit(0).cast("long")
        for k in range(len(FILTERS)):
            bit = 1 << k
            parts = parts + F.when(s.bitwiseAND(F.lit(bit)) != 0, F.get(known, s - bit)).otherwise(F.lit(0).cast("long"))
        return F.array_append(known, F.call_function("div", F.get(game, s) * WHOLE + parts, F.bit_count(s)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic)."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 32 a part
    games = cells.select("part", "cells", F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"),
                         *[_game(F.col("cells"), c).alias(c) for c in COUNTS])
    games = games.withColumn("potential", _potential(F.col("n")))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    member = lambda k, last: F.instr("filter_order", FILTERS[k]) <= last
    coalition = lambda last: sum((F.when(member(k, last), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(len(FILTERS))), F.lit(0))
    steps = steps.withColumn("upto", coalition(F.col("step"))).withColumn("before", coalition(F.col("step") - 1))
    own = F.col("upto") - F.col("before")
    gain = lambda name: F.get(name, F.col("upto")) - F.get(name, F.col("before"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", F.col("upto"))).alias("kept"), gain("n").alias("removed"),
        (F.get("n", own) - gain("n")).alias("redundant"),
        # Failing only this filter: what all filters remove and the others don't.
        (F.get("n", F.lit(ALL)) - F.get("n", F.lit(ALL) - own)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        ((F.get("potential", F.lit(ALL)) - F.get("potential", F.lit(ALL) - own)) * (120 // WHOLE)).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of every part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(failure_counts(docs, labels, id_col, text_col, part_col))
