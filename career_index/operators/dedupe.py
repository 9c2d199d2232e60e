"""Unions and ordered deduplication.

Order is data: every row carries order columns that form a total order (``source_rank, seq``
for candidates, a single ``ord`` for company lists). "First" always means the minimum order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.constants import SOURCES
from career_index.functions.text import _c, ustrip
from career_index.functions.urls import final_url_of_stripped
from career_index.storage import release, stored

JOB_TYPE = "array<struct<title:string,url:string>>"
# Global order of candidates inside one list: source rank times this stride plus ``seq``.
ORD_SOURCE_STRIDE = 10 ** 15


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Concatenate per-source candidates in the fixed source order, keeping provenance. An unknown source is an error."""
    unknown = sorted(set(frames) - set(SOURCES))
    if unknown or not frames:
        raise ValueError(f"sources must be among {SOURCES}, got {unknown or 'none'}")
    parts = [frames[name].withColumn("source_rank", F.lit(rank).cast("int")) for rank, name in enumerate(SOURCES) if name in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def candidate_order() -> Column:
    """(source_rank, seq) as one long; a ``seq`` that doesn't fit its source's range is an error."""
    fits = F.col("seq").between(0, ORD_SOURCE_STRIDE - 1)
    return F.when(fits, F.col("source_rank").cast("long") * ORD_SOURCE_STRIDE + F.col("seq")).otherwise(
        F.raise_error(F.lit(f"seq must be from 0 to {ORD_SOURCE_STRIDE - 1}")).cast("long"))


def union_lists(*frames: DataFrame) -> DataFrame:
    """Concatenate company lists; the global order is (``list_rank``, ``ord``): list position, then order inside the list."""
    parts = [f.withColumn("list_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_wins(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Keep the first row (minimum ``order``) for each key.

    Map-side partial ``min`` per key, then a semi-join on the (unique) order columns: a hot key
    never lands in one task, and the join key is unique so the join is evenly spread.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    firsts = df.groupBy(*named).agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return df.join(firsts, on=order, how="left_semi")


def candidate_key(df: DataFrame) -> list[Column]:
    """Candidate identity: (lower(strip(name)), lower(strip(website)))."""
    return [F.lower(ustrip(F.coalesce(F.col("name"), F.lit("")))),
            F.lower(ustrip(F.coalesce(F.col("website"), F.lit(""))))]


def dedupe_candidates(df: DataFrame) -> DataFrame:
    """W1 across sources, in (source_rank, seq) order."""
    return first_wins(df, candidate_key(df), ["source_rank", "seq"])


def _job_key(j: Column) -> Column:
    return F.concat(F.lower(j["title"]), F.lit("|"), F.lower(j["url"]))


def clean_jobs(jobs) -> Column:
    """Strip titles, final-URL the links, drop blanks, first-wins on lower(title)|lower(url).

    In-row higher-order functions; linear but for the sort, and the key is computed once per element.
    """
    arr = F.coalesce(_c(jobs), F.array().cast(JOB_TYPE))
    # Each stage stores its result in a field, so no expression is written out twice in the next one.
    bare = F.transform(arr, lambda j: F.struct(ustrip(F.coalesce(j["title"], F.lit(""))).alias("title"), ustrip(F.coalesce(j["url"], F.lit(""))).alias("url")))
    norm = F.transform(bare, lambda j: F.struct(j["title"].alias("title"), final_url_of_stripped(j["url"]).alias("url")))
    valid = F.filter(norm, lambda j: (j["title"] != "") & (j["url"] != ""))
    keyed = F.sort_array(F.transform(valid, lambda j, i: F.struct(_job_key(j).alias("key"), i.alias("i"), j["title"].alias("title"), j["url"].alias("url"))))
    # Sorted by key and place: the first of each run of equal keys stays, then back to the order of places.
    runs = F.transform(F.array(keyed), lambda k: F.filter(k, lambda j, n: (n == 0) | (F.get(k, n - 1)["key"] != j["key"])))
    first = F.sort_array(F.transform(F.element_at(runs, 1), lambda j: F.struct(j["i"].alias("i"), j["title"].alias("title"), j["url"].alias("url"))))
    return F.transform(first, lambda j: F.struct(j["title"].alias("title"), j["url"].alias("url")))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` (_o, _ka, _kb) with ``fa`` / ``fb``: the row is the first with its key. A row without key B is first on it.

    First rows are found again by key and order together, which no two rows share, so a frequent key loads no task."""
    def first(key, flag):
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias("_o")).withColumn(flag, F.lit(True))
    out = rows.join(first("_ka", "fa"), ["_ka", "_o"], "left").join(first("_kb", "fb"), ["_kb", "_o"], "left")
    return out.select("_o", "_ka", "_kb", F.col("fa").isNotNull().alias("fa"), (F.col("fb").isNotNull() | F.col("_kb").isNull()).alias("fb"))


def _pruned(rows: DataFrame) -> DataFrame:
    """Without the rows behind one that is first on its other key: by then their key is taken, by that row or by an earlier one."""
    def limit(key, flag, name):
        return rows.where(F.col(flag) & F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias(name))
    out = rows.join(limit("_ka", "fb", "la"), "_ka", "left").join(limit("_kb", "fa", "lb"), "_kb", "left")
    return out.where((F.col("_o") <= F.coalesce("la", "_o")) & (F.col("_o") <= F.coalesce("lb", "_o"))).select("_o", "_ka", "_kb", "fa", "fb")


def _links(rows: DataFrame) -> DataFrame:
    """(_o, up): rows that are first on one key and second on the other, and the row before them there. Such a row is accepted if and only if that one is dropped."""
    def pairs(key, own, other):
        second = rows.where(~F.col(other) & F.col(key).isNotNull()).groupBy(key).agg(F.min("_o").alias("_o"))
        two = second.join(rows.where(F.col(other)).select(key, F.col("_o").alias("up")), key).select("_o", "up")
        return rows.where(F.col(own) & ~F.col(other)).select("_o").join(two, "_o")
    return pairs("_ka", "fb", "fa").unionByName(pairs("_kb", "fa", "fb"))


def _chain_ends(links: DataFrame, max_doublings: int = 64) -> DataFrame:
    """(_o, up, odd): the row at the end of the chain that each row hangs on, and whether the number of steps to it is odd. Pointers are doubled."""
    open_ = stored(links.withColumn("odd", F.lit(True)), "chains")
    if open_.isEmpty():
        return open_
    done = []
    for _ in range(max_doublings):
        ahead = reduce(lambda a, b: a.unionByName(b), [open_, *done]).select(F.col("_o").alias("up"), F.col("up").alias("next"), F.col("odd").alias("more"))
        step = open_.join(ahead, "up", "left").select("_o", F.coalesce("next", "up").alias("up"),
                                                      (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("next").isNull().alias("end"))
        step = stored(step, "chains")
        done.append(step.where("end").drop("end"))
        open_ = step.where("NOT end").drop("end")
        if open_.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
    raise RuntimeError(f"chains are still open after {max_doublings} doublings")


def greedy_dedupe(df: DataFrame, key_a: Column, key_b: Column, order: list[str], max_rounds: int = 1000) -> DataFrame:
    """Walk rows in order; drop a row if an *accepted* earlier row used its key A or its
    non-empty key B. Dropped rows never register keys.

    Each row is an edge between its two keys; the result is the first maximal matching in order. It is found in rounds over the undecided rows:

    1. A row that is first on both keys is accepted.
    2. Behind a row that is first on one key, the other key is taken whatever becomes of the row, so all later rows with that key go.
    3. Of the rows left, those that are now first on both keys are accepted too, and a row that is first on one key and second on the other is accepted if and only if that one is dropped. Such chains, of any length, are resolved by
       pointer doubling down to a row that is decided; the others wait.
    4. Rows that share a key with an accepted row go.

    Each step is a partial aggregation and a join; loop control reads whether rows are left. Raises if ``max_rounds`` don't decide all rows.
    """
    keys = df.select(F.struct(*order).alias("_o"), F.coalesce(key_a, F.lit("")).alias("_ka"), F.when(key_b != "", key_b).alias("_kb"))
    undecided = stored(keys, "undecided")
    accepted_parts = []
    rounds = 0
    while not undecided.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
        rounds += 1
        marked = stored(_marked(undecided), "marked")
        pruned = stored(_pruned(marked).select("_o", "_ka", "_kb"), "pruned")
        live = stored(_marked(pruned), "live")
        release(undecided, marked, pruned)
        both = live.where("fa AND fb").select("_o")
        ends = stored(_chain_ends(_links(live)).join(both.withColumnRenamed("_o", "up"), "up", "left_semi").select("_o", "odd"), "chain-ends")
        accepted = stored(live.join(both.unionByName(ends.where("NOT odd").select("_o")), "_o", "left_semi"), "accepted")
        if accepted.isEmpty():
            raise RuntimeError("undecided rows are left; is the order total?")
        accepted_parts.append(accepted.select("_o"))
        rest = live.join(accepted.select("_o").unionByName(ends.where("odd").select("_o")), "_o", "left_anti")
        rest = (rest.join(accepted.select("_ka").distinct(), "_ka", "left_anti")
                .join(accepted.where(F.col("_kb").isNotNull()).select("_kb").distinct(), "_kb", "left_anti"))
        undecided = stored(rest.select("_o", "_ka", "_kb"), "undecided")
        release(live, ends)
    if not accepted_parts:
        return df.limit(0)
    accepted = reduce(lambda a, b: a.unionByName(b), accepted_parts)
    return df.withColumn("_o", F.struct(*order)).join(accepted, "_o", "left_semi").drop("_o")
