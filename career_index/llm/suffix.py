"""Removal of repeated byte strings by bucket-pointer refinement (operator 10).

Every byte that a ``length``-byte string covers which also starts earlier (smaller id, or same document and earlier start)
is removed. Suffixes of all documents are sorted into buckets as far as this needs, in steps that each leave far fewer suffixes to the next:

1. Whole documents with equal bytes fall into one bucket; the first goes on, the others are copies from end to end.
2. Initial q-gram buckets. Among the q-grams of each string the one with the least hash is its anchor; equal strings have
   their anchors at the same place. Suffixes are bucketed by the q-gram at their anchor. A bucket of one suffix is final.
3. A bucket is refined by the bytes around the anchor, as far as a string that holds it can reach. Within a refined bucket all strings agree
   with those of its first member, so all others are repeats; the first goes on if its q-gram has other refined buckets.
4. Bucket-pointer refinement of what is left: the 8-gram buckets of all positions are refined by sorting on the pair of
   bucket identifiers at a position and at a later offset; the refined identifiers serve as the pointers of the next, doubled step
   (8, 16, 32, ... up to ``length``). Strings end in one bucket if and only if all their bytes agree.

A q-gram with very many refined buckets is salted over several tasks; the first strings of each salt then meet in a
global, map-side combined ``min`` by a 128-bit hash of the string. All other steps are partial aggregations and joins as well, so no bucket has
to fit one task.

Defined results: null text equals empty text. Null ids rank first. Rows with equal id and text are one document and come back alike. Documents shorter than
``length`` bytes lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import free_shuffles, materialize, release, row_key, small_side, text_or_empty

Q = 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BLOCK = 1 << 17


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A mixed 64-bit hash of the q-gram at each position, q a power of two, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, power = 1, _BASE
    while size < q:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power & _MASK
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of its leftmost least value, by doubling."""
    least, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        right = least[step:len(least)]
        n = len(right)
        lower = right < least[:n]
        at = np.where(lower, at[step:], at[:n])
        least = np.where(lower, right, least[:n])
        size += step
    return at


def anchors(texts: list[bytes], length: int, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text index, anchor position, first and last start of the strings that have it, q-gram hash) for all texts."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data, q)
    at = leftmost_min(hashes, length - q + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + length <= (start + sizes)[owner])
    if not len(inside):
        return none, none, none, none, none.astype(np.uint64)
    own, spot = owner[inside], at[inside].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (spot[1:] != spot[:-1])])
    last = np.r_[new[1:], len(inside)] - 1
    text = own[new]
    return text, spot[new] - start[text], inside[new] - start[text], inside[last] - start[text], hashes[spot[new]]


def _blocks(batch, names: tuple[str, ...]):
    """Rows of an Arrow batch in groups of about ``_BLOCK`` bytes, the last column as bytes."""
    cols = [batch.column(n).to_pylist() for n in names[:-1]]
    held: list = []
    size = 0
    for k, body in enumerate(batch.column(names[-1])):
        held.append((*(c[k] for c in cols), body.as_py().encode()))
        size += len(held[-1][-1])
        if size >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for rows in _blocks(b, ("doc_id", "k_hash", "body")):
                text, pos, lo, hi, h = anchors([r[2] for r in rows], length)
                ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(text))
                keys = pa.array([r[1] for r in rows], pa.int64()).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(pos, pa.int32()), pa.array((pos - lo).astype(np.int16)), pa.array((pos - hi).astype(np.int16)),
                                                  pa.array(h.view(np.int64))], ["doc_id", "k_hash", "pos", "lo", "hi", "h"])

    return docs.mapInArrow(run, "doc_id long, k_hash long, pos int, lo short, hi short, h long")


def _context_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, k_hash, h, c, start, first, last): a second hash for each anchor, of the bytes around it; with h it has 128 bits."""
    def run(batches):
        for b in batches:
            out = []
            for doc_id, k_hash, spots, body in (r for rows in _blocks(b, ("doc_id", "k_hash", "spots", "body")) for r in rows):
                for s in spots:
                    pos = s["pos"]
                    start = max(0, pos + Q - length)
                    out.append((doc_id, k_hash, s["h"], xxhash.xxh3_64_intdigest(body[start:pos + length], pos - start), start, pos - s["lo"], pos - s["hi"]))
            doc_ids, keys, hs, cs, starts, firsts, lasts = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(hs, pa.int64()), pa.array(np.array(cs, np.uint64).view(np.int64)),
                 pa.array(starts, pa.int32()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                ["doc_id", "k_hash", "h", "c", "start", "first", "last"])

    return docs.mapInArrow(run, "doc_id long, k_hash long, h long, c long, start int, first int, last int")


def _span_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, k_hash, h, k, salt, first, last, span): the bytes of the strings that start at first to last."""
    def run(batches):
        for b in batches:
            out = []
            for doc_id, k_hash, spots, body in (r for rows in _blocks(b, ("doc_id", "k_hash", "spots", "body")) for r in rows):
                out.extend((doc_id, k_hash, s["h"], s["k"], s["salt"], s["first"], s["last"], body[s["first"]:s["last"] + length]) for s in spots)
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "k_hash", "h", "k", "salt", "first", "last", "span"])

    return docs.mapInArrow(run, "doc_id long, k_hash long, h long, k int, salt int, first int, last int, span binary")


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket identifiers of the ``length``-byte strings at all positions of ``data``: equal if and only if the bytes are."""
    size = 1
    ids = data.astype(np.int64)
    while size < min(8, length):  # initial buckets: up to 8 bytes in one number
        step = min(size, min(8, length) - size)
        ids = (ids[:len(ids) - step] << (8 * step)) + (ids[step:] & ((1 << (8 * step)) - 1))
        size += step
    ids = np.unique(ids, return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)  # the pointer at this offset covers the rest of the longer string
        ids = np.unique(ids[:len(ids) - step] * np.int64(len(ids) + 1) + ids[step:], return_inverse=True)[1]
        size += step
    return ids


def _repeats(rows: pd.DataFrame, length: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, bytes]:
    """Every string of the spans in ``rows``, with ``repeat``: an equal one starts earlier among them."""
    spans = rows["span"].tolist()
    data = b"".join(spans)
    counts = (rows["last"] - rows["first"] + 1).to_numpy()
    base = np.cumsum([len(x) for x in spans]) - np.array([len(x) for x in spans])
    owner = np.repeat(np.arange(len(rows)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    bucket = refine(np.frombuffer(data, np.uint8), length)[base[owner] + offset]
    pos = rows["first"].to_numpy()[owner] + offset
    ids = rows["doc_id"]
    order = np.lexsort((pos, rows["k_hash"].to_numpy()[owner], ids.fillna(0).to_numpy().astype(np.int64)[owner], ids.notna().to_numpy()[owner], bucket))
    repeat = np.zeros(len(bucket), bool)
    repeat[order[1:]] = bucket[order[1:]] == bucket[order[:-1]]
    strings = pd.DataFrame({"doc_id": ids.to_numpy()[owner], "k_hash": rows["k_hash"].to_numpy()[owner], "pos": pos, "repeat": repeat, "salted": rows["k"].to_numpy()[owner] > 1})
    return strings, owner, base[owner] + offset, data


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, k_hash, start, stop, d1, d2): repeats have null hashes; first strings of salted groups carry the hash of their bytes."""
    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        strings, owner, at, data = _repeats(rows, length)
        gone = strings[strings["repeat"]]
        own = owner[strings["repeat"].to_numpy()]
        pos = gone["pos"].to_numpy()
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + 1)]) if len(pos) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(pos)] - 1 if len(pos) else new
        runs = pd.DataFrame({"doc_id": gone["doc_id"].to_numpy()[new], "k_hash": gone["k_hash"].to_numpy()[new], "start": pos[new], "stop": pos[last] + length})
        left = (~strings["repeat"] & strings["salted"]).to_numpy()
        digests = [xxhash.xxh3_128_digest(data[k:k + length]) for k in at[left].tolist()]
        rest = pd.DataFrame({"doc_id": strings["doc_id"].to_numpy()[left], "k_hash": strings["k_hash"].to_numpy()[left], "start": strings["pos"].to_numpy()[left],
                             "stop": strings["pos"].to_numpy()[left] + length,
                             "d1": [int.from_bytes(d[:8], "little", signed=True) for d in digests], "d2": [int.from_bytes(d[8:], "little", signed=True) for d in digests]})
        out = pd.concat([runs.assign(d1=None, d2=None), rest], ignore_index=True)
        return out.astype({c: "Int64" for c in ("doc_id", "k_hash", "start", "stop", "d1", "d2")})

    def run(batches):
        rest = None
        for pdf in batches:
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            same = ((pdf["h"] == pdf["h"].iloc[-1]) & (pdf["salt"] == pdf["salt"].iloc[-1])).to_numpy()
            cut = len(pdf) - int(same.sum())  # rows are sorted; the last group may go on
            if cut >= 2048:
                yield spans(pdf.iloc[:cut].reset_index(drop=True))
                pdf = pdf.iloc[cut:].reset_index(drop=True)
            rest = pdf
        if rest is not None and len(rest):
            yield spans(rest)

    return contexts.mapInPandas(run, "doc_id long, k_hash long, start int, stop int, d1 long, d2 long")


def _with_spots(docs: DataFrame, spots: DataFrame) -> DataFrame:
    side = spots.select(F.col("doc_id").alias("i"), F.col("k_hash").alias("j"), "spots")
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k_hash") == F.col("j"))).select("doc_id", "k_hash", "spots", "body")


def repeated_spans(docs: DataFrame, length: int = 100, group: int = 2048) -> DataFrame:
    """(doc_id, k_hash, spans) of documents (doc_id, k_hash, body), all different: stretches that repeat earlier strings."""
    place = F.struct("doc_id", "k_hash", "start")
    grams = materialize(_anchor_rows(docs, length), "suffix-anchors")
    shared = grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    shared = materialize(shared, "suffix-shared")
    spots = grams.join(shared, "h").groupBy("doc_id", "k_hash").agg(F.collect_list(F.struct("pos", "lo", "hi", "h")).alias("spots"))
    spots = materialize(spots, "suffix-spots")
    release(grams)
    free_shuffles(docs.sparkSession)
    contexts = materialize(_context_rows(_with_spots(docs, spots), length), "suffix-contexts")
    release(spots)
    refined = contexts.groupBy("h", "c").agg(F.min(F.struct("doc_id", "k_hash", "start", "first", "last")).alias("m"), F.count(F.lit(1)).alias("n"))
    refined = materialize(refined, "suffix-refined")
    free_shuffles(docs.sparkSession)
    heads = refined.filter("n > 1").select("h", "c", F.struct("m.doc_id", "m.k_hash", "m.start").alias("head"))
    copies = contexts.join(heads, ["h", "c"]).filter(~place.eqNullSafe(F.col("head")))
    copies = materialize(copies.select("doc_id", "k_hash", F.col("first").alias("start"), (F.col("last") + length).alias("stop")), "suffix-repeats")
    release(contexts)
    free_shuffles(docs.sparkSession)
    many = refined.groupBy("h").agg(F.count(F.lit(1)).alias("buckets")).filter("buckets > 1")
    left = refined.join(many, "h").select("h", F.ceil(F.col("buckets") / group).cast("int").alias("k"), "m.*")
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k_hash", "start"), F.col("k")).cast("int"))
    left = left.groupBy("doc_id", "k_hash").agg(F.collect_list(F.struct("h", "k", "salt", "first", "last")).alias("spots"))
    left = materialize(left, "suffix-left")
    free_shuffles(docs.sparkSession)
    dealt = _span_rows(_with_spots(docs, left), length).repartition("h", "salt").sortWithinPartitions("h", "salt")
    done = materialize(_refined(dealt, length), "suffix-strings")
    free_shuffles(docs.sparkSession)
    firsts = done.filter("d1 IS NOT NULL")
    low = firsts.groupBy("d1", "d2").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = firsts.join(low, ["d1", "d2"]).filter(~place.eqNullSafe(F.col("head"))).select("doc_id", "k_hash", "start", "stop")
    parts = copies.unionByName(done.filter("d1 IS NULL").select("doc_id", "k_hash", "start", "stop")).unionByName(later)
    return parts.groupBy("doc_id", "k_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def cut(body: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes outside the union of ``spans``, and the number of its maximal runs."""
    out, at, runs = [], 0, 0
    stop = -1
    for a, b in sorted(spans):
        if a > stop:
            runs += 1
            out.append(body[at:a])
        stop = max(stop, b)
        at = stop
    out.append(body[at:])
    return b"".join(out), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (binary, the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    if length < Q:
        raise ValueError(f"length must be at least {Q}")
    k_id, k_hash = row_key(id_col, text_col)
    rows = docs.select(k_id.alias("doc_id"), k_hash, text_or_empty(text_col).alias("body"))
    long_enough = rows.filter(F.octet_length("body") >= length)
    digests = materialize(long_enough.select("doc_id", "k_hash", F.sha2(F.col("body").cast("binary"), 256).alias("d")), "suffix-digests")
    first = digests.groupBy("d").agg(F.min(F.struct("doc_id", "k_hash")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", "m")
    copies = digests.join(first, "d").filter(~F.struct("doc_id", "k_hash").eqNullSafe(F.col("m"))).select("doc_id", "k_hash").distinct()
    copies = small_side(materialize(copies, "suffix-copies"))
    on = lambda side: rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["k_hash"] == side["k_hash"])
    found = repeated_spans(long_enough.join(copies, on(copies), "left_anti"), length)
    whole = copies.select("doc_id", "k_hash", F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop"))).alias("spans"))
    spans = materialize(found.unionByName(whole), "suffix-spans")
    free_shuffles(docs.sparkSession)
    joined = rows.join(spans, on(spans), "left").select(rows["doc_id"], "body", "spans")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, own, body in (r for part in _blocks(b, ("doc_id", "spans", "body")) for r in part):
                kept, runs = cut(body, [(s["start"], min(s["stop"], len(body))) for s in own]) if own else (body, 0)
                out.append((doc_id, kept, len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
