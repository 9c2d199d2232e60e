"""SimHash near-duplicate detection with pigeonhole blocks (operator 6).

A fingerprint is split into blocks. Two fingerprints that differ in at most ``max_bits`` bits leave
at least ``blocks - max_bits`` blocks untouched, so they agree on some combination of that many
blocks: each fingerprint is keyed by every combination, rows with equal keys meet, and the Hamming
distance of each meeting pair is verified.

Equal fingerprints are one node, however many documents carry them. A key that more than ``cell``
fingerprints share is dealt into cells: its fingerprints are salted into chunks and every pair of
chunks is a cell of its own, so no task compares more than ``2 * cell`` fingerprints at once and no
pair is left out. A cell reports a spanning forest of its verified links instead of all pairs, which keeps
every component whole while the output stays below the number of rows.

Defined results: null text has no words, like empty text; a text without words has fingerprint zero and is
linked like any other. Null ids sort before all others only where every document of a component has a null id;
otherwise the component carries its smallest id. Rows with equal id and text are one document. An empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import keep_rows, materialize, row_key, text_or_empty
from career_index.llm.components import components

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash over word shingles; words are split at ASCII white space and lower-cased in A-Z."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    spans = list(zip(starts[:n].tolist(), ends[width - 1:].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = spans[at:at + _CHUNK]
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, k_hash, fp) for each row, fp as a signed long."""
    k_id, k_hash = row_key(id_col, text_col)

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("body")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k_hash"), pa.array(fps.view(np.int64))], ["doc_id", "k_hash", "fp"])

    rows = docs.select(k_id.alias("doc_id"), k_hash, text_or_empty(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, k_hash long, fp long")


def block_masks(blocks: int, share: int) -> list[int]:
    """Signed 64-bit masks, one for every combination of ``share`` of the ``blocks``."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, share)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _cells(fps: DataFrame, masks: list[int], cell: int) -> DataFrame:
    """(key, a, b, side, fp): the rows of every cell. A key below the limit is one cell with a = b = 0."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(shared, "key").withColumn("k", F.ceil(F.col("n") / F.lit(cell)).cast("int"))
    salt: Column = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    rows = rows.withColumn("own", F.when(F.col("k") > 1, salt).otherwise(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one cell: (fingerprint, root fingerprint) pairs."""
    n = len(fp)
    label = np.arange(n)
    step = max(1, (1 << 22) // n)
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(fp[at:at + step, None] ^ fp[None, :]) <= max_bits
            new[at:at + step] = np.minimum(new[at:at + step], np.where(near, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(n)
    return fp[moved], fp[label[moved]]


def _links_of(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of sorted rows: all pairs of small cells at once, a forest for each larger one."""
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    us, vs = [], []
    small = size <= 8
    at = np.repeat(start[small], size[small]) + np.concatenate([np.arange(s) for s in size[small]] or [np.zeros(0, np.int64)])
    end = np.repeat(start[small] + size[small], size[small])
    for d in range(1, 8):
        live = at + d < end
        at, end = at[live], end[live]
        near = np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits
        us.append(fp[at[near]])
        vs.append(fp[at[near] + d])
    for s, n in zip(start[~small], size[~small], strict=True):
        u, v = _forest(fp[s:s + n], max_bits)
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, cell: int = 1024) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp: long) that connect all that lie within ``max_bits`` bits."""
    if not 0 <= max_bits < blocks:
        raise ValueError("blocks must exceed max_bits")
    masks = block_masks(blocks, blocks - max_bits)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["key", "a", "b"]].to_numpy()
            last = key[-1]
            cut = int(np.argmax((key == last).all(axis=1)))  # rows of the last cell may go on in the next batch
            rest = pdf.iloc[cut:]
            u, v = _links_of(key[:cut], pdf["fp"].to_numpy()[:cut].view(np.uint64), max_bits)
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})
        if rest is not None:
            u, v = _links_of(rest[["key", "a", "b"]].to_numpy(), rest["fp"].to_numpy().view(np.uint64), max_bits)
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    cells = _cells(fps, masks, cell)
    dealt = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInPandas(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = 4, blocks: int = 6, cell: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, root, k_hash.

    component_id is the smallest id that links lead to (null if none there has one); root, a fingerprint, tells components apart.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = components(links(nodes.select("fp"), max_bits, blocks, cell))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id", "root"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "k_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays, of several with that id the one
    with the least text hash; where no document of a component has an id, that decides among all."""
    found = materialize(simhash_components(docs, id_col, text_col, shingle, max_bits), "near-rows")
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    picks = found.filter(own).groupBy("root").agg(F.min("k_hash").alias("k_hash")).withColumn("picked", F.lit(True))
    verdicts = found.join(picks, ["root", "k_hash"], "left").select(
        F.col("doc_id").alias("k_id"), "k_hash", (own & F.col("picked").isNotNull()).alias("kept"))
    return keep_rows(docs, verdicts, id_col, text_col)
