"""Text keys and string-semantics helpers.

Python's ``str.strip`` and ``\\s`` are Unicode-aware, Spark's ``trim`` only strips spaces, so
whitespace handling goes through Unicode-mode regexes where a text isn't ASCII. ``fold`` equals ``str.casefold``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode whitespace plus the four ASCII separators Python also treats as space.
_WS = r"[\s\x{1c}-\x{1f}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The ASCII part of the same set, for the paths without a Unicode pattern.
_ASCII_WS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` added behind a generator: later filters on them aren't pushed below it, where each would write out their expressions again."""
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, row).select(*kept, *[F.col(f"_settled.{n}").alias(n) for n in columns])


def stripped(x: Column) -> Column:
    """``ustrip`` of a column that costs nothing to read again: texts with a visible ASCII character at both ends are left without a lambda."""
    visible = lambda ch: F.ascii(ch).between(33, 126)
    return F.when((x == "") | visible(x) & visible(F.right(x, F.lit(1))), x).otherwise(ustrip(x))


def ustrip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace.

    Trimming ASCII whitespace is enough if an ASCII character is at either end then; only other texts meet the pattern."""
    def trimmed(x: Column) -> Column:
        plain = lambda b: F.when((F.ascii(b) < 128) & (F.ascii(F.right(b, F.lit(1))) < 128), b)
        return let(F.btrim(x, F.lit(_ASCII_WS)), lambda b: plain(b).otherwise(F.regexp_replace(x, rf"(?U)^{_WS}+|{_WS}+\z", "")))
    return let(_c(c), trimmed)


def collapsed(x: Column) -> Column:
    """``collapse_ws`` of a column that costs nothing to read again."""
    return F.when(F.length(x) == F.octet_length(x), F.when(x.rlike(rf"{_WS}{{2}}|[^\S ]|[\x{{1c}}-\x{{1f}}]"), F.regexp_replace(x, rf"{_WS}+", " ")).otherwise(x)) \
        .otherwise(F.regexp_replace(x, rf"(?U){_WS}+", " "))


def collapse_ws(c) -> Column:
    """``re.sub(r"\\s+", " ", s)`` with Unicode whitespace; ASCII texts take a cheaper pattern, and only where it changes something."""
    return let(_c(c), collapsed)


def name_key(c) -> Column:
    """Lower-case, collapse whitespace runs to one space, strip."""
    return ustrip(collapse_ws(F.lower(_c(c))))


def clean_cell(c) -> Column:
    """Drop ``[...]`` footnote markers, collapse whitespace, strip."""
    return ustrip(collapse_ws(F.regexp_replace(_c(c), r"\[[^\]]+\]", "")))


def _fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Case folding of single characters that become one character, and of those that become several (after ``lower``)."""
    one, many = {}, {}
    for point in [*range(128, 0xD800), *range(0xE000, 0x110000)]:
        folded = chr(point).casefold()
        if folded != chr(point):
            (one if len(folded) == 1 else many)[chr(point)] = folded
    return one, many


_FOLD_ONE, _FOLD_MANY = _fold_tables()


def fold(c) -> Column:
    """``str.casefold()``. ASCII texts are only lower-cased; others meet a map of characters, with one-to-many entries where needed."""
    def folded(x: Column) -> Column:
        several = F.from_json(F.lit(json.dumps(_FOLD_MANY)), "map<string,string>")
        # Every character is folded by itself: lower-casing would depend on its neighbours and on the version of Unicode.
        spread = F.when(x.rlike("[" + "".join(_FOLD_MANY) + "]"), F.array_join(F.transform(
            F.split(x, ""), lambda ch: F.coalesce(F.element_at(several, ch), ch)), "")).otherwise(x)
        capitals = "".join(map(chr, range(65, 91)))
        return F.translate(spread, capitals + "".join(_FOLD_ONE), capitals.lower() + "".join(_FOLD_ONE.values()))

    return let(_c(c), lambda x: F.when(F.length(x) == F.octet_length(x), F.lower(x)).otherwise(folded(x)))


def contains_folded(hay, needle) -> Column:
    """``needle.casefold() in hay.casefold()`` (an empty needle matches)."""
    n = needle if isinstance(needle, Column) else F.lit(needle)
    return fold(hay).contains(fold(n))
