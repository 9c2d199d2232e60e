"""Substring deduplication by unit hashing (operator 8).

A text is cut into sentences, which end at their marks and at line ends. A sentence of ``min_sentence_words`` is a unit. Shorter ones are
units together with their neighbours: from each sentence the shortest run forwards and the shortest run backwards, across line ends, that
has as many words. In a repeated run of whole sentences these runs cover every sentence, so a passage of short sentences or short lines
goes as a whole. Whole lines of ``min_line_words`` are units too. Units are normalised (lower case, runs of white space to one space,
trimmed) and hashed to 128 bits. Digests are grouped globally with a map-side ``min``; of each digest the earliest ranked occurrence
(smallest id, then smallest offset) stays and every other occurrence is removed from its text. Offsets
of what was removed refer to the original text.

All units are judged on the input, independently; what is removed is the union. Runs and lines with fewer words
are too common in plain prose to count as copies and always stay. Where a script sets no spaces between words, two characters
(ideographs, kana) or four (Thai, Lao, Burmese, Khmer) count as a word; in the latter a space ends a sentence.

Defined results: null text equals empty text. Null ids rank first. Rows with equal id and text are one document and come
back alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import materialize, release, row_key, small_side, text_or_empty

_MARKS = ".!?\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965"
_THAI = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"  # Thai, Lao, Burmese, Khmer
_SENTENCE = re.compile(rf"[^{_MARKS}\n]*[{_MARKS}]*\s*")
_CLAUSE = re.compile(rf"(?:(?!(?<=[{_THAI}])\s+[{_THAI}])[^{_MARKS}\n])*[{_MARKS}]*\s*")
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_NO_SPACE = re.compile(f"[{_THAI}]")
_UNITS = "k_id long, k_hash long, start int, stop int, d1 long, d2 long"


def n_words(words: list[str]) -> int:
    """White-space words; a word in a script without spaces counts by its characters."""
    return len(words) + sum(max((len(_IDEOGRAPH.findall(w)) + 1) // 2 + (len(_NO_SPACE.findall(w)) + 3) // 4 - 1, 0) for w in words if not w.isascii())


def units(text: str, min_line_words: int, min_sentence_words: int):
    """(start, stop, digest) of every line, sentence and run of sentences that is long enough.

    What begins and ends with a line spans its line end too.
    """
    sentence = _CLAUSE if _NO_SPACE.search(text) else _SENTENCE
    starts, stops, sizes, ends, digests, lines = [], [], [], [], [], {}  # of each sentence; ends: of its line, if it ends that
    at = 0
    for line in text.split("\n"):
        stop = min(at + len(line) + 1, len(text))
        head = len(starts)
        for m in sentence.finditer(line):
            if words := m[0].lower().split():
                starts.append(at + m.start() if len(starts) > head else at)
                stops.append(at + m.end())
                sizes.append(n_words(words))
                # A mark without white space after it doesn't equal one with.
                glue = b" " if m.end() == len(line) or m[0][-1].isspace() else b""
                digests.append((xxhash.xxh3_128_digest(" ".join(words).encode()), glue))
                ends.append(0)
        if len(starts) > head:
            ends[-1] = stop
            lines[head] = len(starts) - 1
            if sum(sizes[head:]) >= min_line_words and n_words(line.lower().split()) >= min_line_words:
                yield at, stop, _run(digests[head:])
            else:
                del lines[head]
        at = stop
    begins = {0, *(k + 1 for k, e in enumerate(ends) if e)}

    def run(i, j):
        return starts[i], ends[j] if i in begins and ends[j] else stops[j], _run(digests[i:j + 1])

    i = size = 0
    for j, own in enumerate(sizes):
        size += own
        if size < min_sentence_words and i and lines.get(i - 1) != j:
            yield run(i - 1, j)  # the shortest run backwards from j
        while size >= min_sentence_words:
            if lines.get(i) != j:
                yield run(i, j)  # the shortest run forwards from i; the last of them is the shortest backwards from j as well
            size -= sizes[i]
            i += 1


def _run(digests: list[tuple[bytes, bytes]]) -> bytes:
    if len(digests) == 1:
        return digests[0][0]
    return xxhash.xxh3_128_digest(b"".join([x for d in digests for x in d][:-1]))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the union of ``spans``, and that union as (start, length)."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return "".join(out), [(a, b - a) for a, b in merged]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_words: int = 8,
                   min_sentence_words: int = 8) -> DataFrame:
    """(k_id, k_hash, spans): for each row with something to remove, the spans of units that occur earlier."""

    def run(batches):
        for b in batches:
            ids, hashes, starts, stops, d1, d2 = [], [], [], [], [], []
            for k_id, k_hash, body in zip(b.column("k_id").to_pylist(), b.column("k_hash").to_pylist(), b.column("body"), strict=True):
                for a, e, digest in units(body.as_py(), min_line_words, min_sentence_words):
                    ids.append(k_id)
                    hashes.append(k_hash)
                    starts.append(a)
                    stops.append(e)
                    d1.append(int.from_bytes(digest[:8], "little", signed=True))
                    d2.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                 pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], ["k_id", "k_hash", "start", "stop", "d1", "d2"])

    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("body"))
    units_table = found = materialize(rows.mapInArrow(run, _UNITS), "units")
    # Most units occur once; half a digest tells them apart at a fraction of the shuffle.
    again = found.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1")
    found = materialize(found.join(small_side(materialize(again, "unit-digests")), "d1", "left_semi"), "unit-repeats")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("k_id", "start", "k_hash", "stop")).alias("first"))
    # Joined by digest and document, so that the occurrences of a digest that a third of all rows share meet the first one in no single task: only a
    # digest's first document finds a partner.
    doc_key = lambda c: F.xxhash64(c).alias("k_key")  # noqa: E731  (null ids have a key too)
    first = first.select("d1", "d2", F.col("first.k_hash").alias("k_hash"), doc_key("first.k_id"), F.col("first.k_id").alias("f_id"),
                         F.col("first.start").alias("f_start"), F.col("first.stop").alias("f_stop"))
    held = found.select("*", doc_key("k_id")).join(first, ["d1", "d2", "k_hash", "k_key"], "left")
    same = F.coalesce(F.col("k_id").eqNullSafe(F.col("f_id")) & F.col("f_start").isNotNull(), F.lit(False))
    later = held.filter(~(same & (F.col("start") == F.col("f_start")) & (F.col("stop") == F.col("f_stop"))))
    # An occurrence that begins within the first one is removed only beyond it.
    later = later.withColumn("start", F.when(same, F.greatest("start", "f_stop")).otherwise(F.col("start"))).filter("start < stop")
    spans = materialize(later.groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "unit-spans")
    release(units_table)
    release(found)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_words: int = 8,
                   min_sentence_words: int = 8) -> DataFrame:
    """``docs`` with all its columns, its text cut, and a last column ``removed``: array of (start, length) in the original text."""
    spans = repeated_spans(docs, id_col, text_col, min_line_words, min_sentence_words)
    k_id, k_hash = row_key(id_col, text_col)
    taken = {c.lower() for c in docs.columns}
    out_col = next(c for c in ("removed", *(f"removed_{i}" for i in range(len(taken) + 1))) if c not in taken)

    @F.pandas_udf("body string, removed array<struct<start: int, length: int>>")
    def apply(body: pd.Series, gone: pd.Series) -> pd.DataFrame:
        done = [cut(t, [(int(x["start"]), int(x["stop"])) for x in g]) if g is not None else (t, []) for t, g in zip(body, gone, strict=True)]
        return pd.DataFrame({"body": [t for t, _ in done], "removed": [[{"start": a, "length": n} for a, n in r] for _, r in done]})

    side = spans.select(F.col("k_id").alias("__k_id"), F.col("k_hash").alias("__k_hash"), F.col("spans").alias("__spans"))
    joined = docs.join(side, k_id.eqNullSafe(F.col("__k_id")) & (k_hash == F.col("__k_hash")), "left")
    joined = joined.withColumn("__cut", apply(text_or_empty(text_col), F.col("__spans")))
    kept = [F.when(F.col(text_col).isNotNull(), F.col("__cut.body")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.col("__cut.removed").alias(out_col))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_words: int = 8,
                min_sentence_words: int = 8) -> DataFrame:
    """``docs`` with repeated units cut out of the text; other columns as they were."""
    out = remove_repeats(docs, id_col, text_col, min_line_words, min_sentence_words)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
