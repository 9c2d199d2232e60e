"""Quality rules as a short-circuit cascade (operator 5, native).

A rule is a named Column that is true for a text to reject. On a bounded sample (the ``sample_rows`` rows with the least text hash) each rule's cost and
selectivity (share of rejected rows) are measured, and the rules are put in order of rejection per
cost. The cost is the least of several timed runs over the repeated sample, after one that isn't timed, less the time of reading it, in steps of a factor of two, so that noise rarely changes the order.
The cascade is one nested CASE in that order: a rule, and what only it reads, runs only for texts that all earlier ones accepted. The order changes the work,
never the verdict, which is the disjunction of all rules.

All statistics are built-in functions over the whole text. Words are runs of ``[^\\x20\\x09-\\x0D]``.

Defined results: null text equals empty text: no words, so it is rejected. Every row is judged by itself, so repeated rows and null ids
need no care. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import let, materialize, release, text_or_empty

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SHOUT = "!!"


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def word_chars(own: Column) -> Column:
    return F.length(F.array_join(own, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long")


def n_shouts(text: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(SHOUT), F.lit("")))) / len(SHOUT)).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(own: Column, width: int = 3) -> Column:
    """Words covered by ``width``-word windows that occur at least twice among the words ``own``."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    def again(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k).getField("h") == x.getField("h"), F.lit(False))
        found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]))
        return F.slice(hashes, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), again))

    return let(windows(own), count)


def statistics(text: Column) -> Column:
    """A struct of the statistics that are reported for every text, with the words split once."""
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words")))


#: Each rule from a lookup of statistics: a struct column's fields, or expressions over the text itself.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda s: s("n_words") < 50,
    "repeated_windows": lambda s: 100 * s("n_repeat_words") > 50 * s("n_words"),
    "symbols": lambda s: 10 * s("n_symbols") > s("n_words"),
    "repeated_lines": lambda s: 2 * s("n_dup_lines") > s("n_lines"),
    "word_length": lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 15 * s("n_words")),
    "shouting": lambda s: 5 * s("n_shouts") > s("n_words"),
}
BASE = ("few_words", "repeated_windows")
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def from_text(text: Column) -> Callable[[str], Column]:
    """Statistics computed where a rule needs them, so that a rule that isn't reached costs nothing."""
    own = {
        "n_words": lambda: F.size(words(text)).cast("long"), "word_chars": lambda: let(words(text), word_chars), "n_symbols": lambda: n_symbols(text),
        "n_dup_lines": lambda: n_dup_lines(text), "n_repeat_words": lambda: let(words(text), n_repeat_words),
        "n_lines": lambda: F.size(lines(text)).cast("long"), "n_shouts": lambda: n_shouts(text),
    }
    return lambda name: own[name]()


def _seconds(sample: DataFrame, rejects: Column, copies: int, runs: int) -> tuple[float, float]:
    """(share of rejected rows, least time of a run) over ``copies`` of the sample."""
    every = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    query = every.agg(F.avg(rejects.cast("int")))
    share, best = query.first()[0], float("inf")  # this run warms up
    for _ in range(runs):
        began = time.perf_counter()
        query.first()
        best = min(best, time.perf_counter() - began)
    return share or 0.0, best


def rule_order(docs: DataFrame, text_col: str = "text", sample_rows: int = 500, rules=None, copies: int = 8, runs: int = 3) -> list[str]:
    """Rule names by rejection per cost, measured on ``sample_rows`` rows; ties by name."""
    rules = rules or RULES
    body = docs.select(text_or_empty(text_col).alias("body"))
    sample = materialize(body.orderBy(F.xxhash64("body"), "body").limit(sample_rows), "quality-sample")
    _, reading = _seconds(sample, F.length("body") < 0, copies, runs)
    scored = []
    for name, rule in rules.items():
        share, seconds = _seconds(sample, rule(from_text(F.col("body"))), copies, runs)
        scored.append((-share / 2.0 ** round(math.log2(max(seconds - reading, 1e-3))), name))
    release(sample)
    return [name for _, name in sorted(scored)]


def first_rejection(order: list[str], value: Callable[[str], Column], rules=None) -> Column:
    """The name of the first rule in ``order`` that rejects, or null: one CASE, evaluated only as far as needed."""
    rules = rules or RULES
    case = F
    for name in order:
        case = case.when(rules[name](value), F.lit(name))
    return case.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, base_failed, kept."""
    order = rule_order(docs, text_col, sample_rows)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"), statistics(text).alias("s"))
    later = from_text(F.col("body"))
    # Reported statistics are there anyhow; the others are computed where the cascade gets to a rule that reads them.
    value = lambda name: F.col(f"s.{name}") if name in REPORTED else later(name)
    base = RULES[BASE[0]](value) | RULES[BASE[1]](value)
    return rows.select("doc_id", *[f"s.{c}" for c in REPORTED], base.alias("base_failed"), first_rejection(order, value).isNull().alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; no shuffle."""
    order = rule_order(docs, text_col, sample_rows)
    return docs.filter(first_rejection(order, from_text(text_or_empty(text_col))).isNull())
