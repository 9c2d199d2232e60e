"""Line deduplication with a deletion-neighbourhood join (operator 9, native).

Lines are normalised (lower case, runs of white space to one space, trimmed). Two lines match if they are equal or one edit apart: one
character put in, taken out, or replaced. A line is removed if a line that matches it occurs earlier anywhere
(smaller id, then smaller line number), whether that one stays or not.

Equal lines form one class, found by a 128-bit hash and a map-side ``min`` of their places. For each class all
variants with one character taken out are emitted as hashed keys: with their position, lines one replacement apart meet; without it, a line
meets the lines that are one character longer. Within a key all lines match each other (or the shorter line), so each is
compared with the earliest only: links grow with the lines, not with the pairs, and a key that a third of all lines share is combined map-side. Every link
is verified by edit distance on the texts.

Variants are emitted only where they can meet. A line is cut into blocks; lines one edit apart agree on all but one block, so classes
that share a hash of all-but-one-block with no other class have no variants to meet, and the others have variants only within that
block. The test is exact: it drops no pair.

Defined results: null text equals empty text. Blank lines are not judged. Null ids rank first. Rows with equal id and text are one document and
share verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import materialize, row_key, small_side, text_or_empty

BLOCKS = 3


def normal(line: Column) -> Column:
    low = F.lower(line)
    odd = F.contains(low, F.lit("  ")) | F.rlike(low, F.lit("[\\t\\x0B\\f\\r]"))
    return F.btrim(F.when(odd, F.regexp_replace(low, "\\s+", " ")).otherwise(low))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k_hash, line, s): one row per line that isn't blank, s normalised."""
    k_id, k_hash = row_key(id_col, text_col)
    # Normalised inside the generator, so that what reads s later doesn't normalise again.
    own = F.transform(F.split(text_or_empty(text_col), "\n"), lambda x: normal(x))
    return docs.select(k_id.alias("doc_id"), k_hash, F.posexplode(own).alias("line", "s")).filter("s != ''")


def _edges(length: Column, block: Column | int) -> tuple[Column, Column]:
    """First position of a block, and the first after it."""
    return (F.floor(length * block / BLOCKS).cast("int"), F.floor(length * (block + 1) / BLOCKS).cast("int"))


def _block_keys(s: Column) -> list[Column]:
    """Key 2j + k: the line without its j-th block, blocks cut for its own length (k = 0) or for one character less (k = 1)."""
    out = []
    for block in range(BLOCKS):
        for less in (0, 1):
            size = F.length(s) - less
            low, high = _edges(size, block)
            out.append(F.xxhash64(F.lit(block), size, F.substring(s, F.lit(1), low), F.substring(s, F.length(s) - (size - high) + 1, size - high)))
    return out


def _variants(found: DataFrame) -> DataFrame:
    """(kind, v, whole, cid): hashed keys of candidate rows (cid, s, slot).

    Kind "r": a character replaced at a position. Kind "d": the line with a character taken out, or whole.
    """
    length, slot = F.length("s"), F.col("slot")
    block, less = F.floor(slot / 2).cast("int"), slot % 2
    low, high = _edges(length - less, block)
    last = F.when(less == 0, high - 1).otherwise(high)
    spots = found.withColumn("at", F.explode(F.when(last >= low, F.sequence(low, last)).otherwise(F.array().cast("array<int>"))))
    rest = F.concat(F.substring(F.col("s"), F.lit(1), F.col("at")), F.substring(F.col("s"), F.col("at") + 2, length))
    cut = spots.select(F.when(less == 0, "r").otherwise("d").alias("kind"),
                       F.when(less == 0, F.xxhash64(rest, "at")).otherwise(F.xxhash64(rest)).alias("v"), F.lit(False).alias("whole"), "cid")
    whole = found.filter(less == 0).select("cid", "s").distinct()
    return cut.unionByName(whole.select(F.lit("d").alias("kind"), F.xxhash64("s").alias("v"), F.lit(True).alias("whole"), "cid"))


def _near(classes: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """(later, earlier): for each class that has one, the earliest class within the edit bound. A class goes by its first place."""
    keyed = classes.select(F.col("first").alias("cid"), F.posexplode("keys").alias("slot", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    slots = small_side(materialize(keyed.join(shared, "key").groupBy("cid").agg(F.collect_set("slot").alias("slots")), "line-slots"))
    found = materialize(texts.join(slots, "cid"), "line-candidates")
    variants = _variants(found.select("cid", "s", F.explode("slots").alias("slot")))
    meet = variants.groupBy("kind", "v").agg(F.min("cid").alias("least"), F.min(F.when(F.col("whole"), F.col("cid"))).alias("short"), F.count(F.lit(1)).alias("n"))
    met = variants.join(meet.filter("n > 1").drop("n"), ["kind", "v"]).withColumn("other", F.when(F.col("kind") == "r", F.col("least")).otherwise(F.col("short")))
    links = met.filter(F.col("other").isNotNull() & (F.col("cid") != F.col("other")))
    links = links.select(F.greatest("cid", "other").alias("later"), F.least("cid", "other").alias("earlier")).distinct()
    text = lambda name: found.select(F.col("cid").alias(name), F.col("s").alias(f"s_{name}"))
    near = links.join(text("later"), "later").join(text("earlier"), "earlier")
    distance = F.levenshtein("s_later", "s_earlier", max_edits)
    return near.filter((distance >= 0) & (distance <= max_edits)).groupBy("later").agg(F.min("earlier").alias("earlier"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1) -> DataFrame:
    """One row per line that isn't blank: doc_id, line, kept, match_doc_id, match_line, k_hash.

    The match is the earliest line that the line equals or is at most ``max_edits`` (0 or 1) edits from, itself if there is none earlier.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    digest = [F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(1), "s").alias("d2")]
    rows = _lines(docs, id_col, text_col).select("doc_id", "k_hash", "line", *digest, F.array(*_block_keys(F.col("s"))).alias("keys"))
    rows = materialize(rows if max_edits else rows.withColumn("keys", F.array().cast("array<bigint>")), "lines")
    place = F.struct("doc_id", "line", "k_hash")
    classes = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max("keys").alias("keys"))
    classes = materialize(classes, "line-classes")
    best = classes.select("d1", "d2", F.col("first").alias("match"))
    if max_edits:
        near = _near(classes, _lines(docs, id_col, text_col).select(place.alias("cid"), "s"), max_edits)
        best = best.join(near, F.col("match") == F.col("later"), "left").select("d1", "d2", F.least("match", F.coalesce("earlier", "match")).alias("match"))
    return rows.join(best, ["d1", "d2"]).select(
        "doc_id", "line", place.eqNullSafe(F.col("match")).alias("kept"), F.col("match.doc_id").alias("match_doc_id"),
        F.col("match.line").alias("match_line"), "k_hash")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1) -> DataFrame:
    """``docs`` with removed lines cut out of the text; other columns as they were."""
    gone = line_verdicts(docs, id_col, text_col, max_edits).filter("NOT kept")
    gone = gone.groupBy(F.col("doc_id").alias("__k_id"), F.col("k_hash").alias("__k_hash")).agg(F.collect_set("line").alias("__gone"))
    k_id, k_hash = row_key(id_col, text_col)
    joined = docs.join(gone, k_id.eqNullSafe(F.col("__k_id")) & (k_hash == F.col("__k_hash")), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
