"""Language identification by cross-parsing entropy (operator 11).

For each language a suffix automaton holds all substrings of a sample of its labelled text. A text is cross-parsed against each automaton: every
phrase is the longest match that starts where the last one ended, found by walking the automaton until no transition is
left. A phrase names a place in the sample, log2(sample length) bits, so phrases * log2(sample length) / text length estimates the
cross entropy; these normalised phrases are comparable between samples of different lengths. The language that needs the fewest wins (ties: first in
code-point order).

Texts are reduced to lower-case letters and marks, every other run to one space, and parsed as UTF-8 bytes, so any script has at most 256
symbols and the automaton is one dense table. Whole texts are parsed, in segments of ``SEGMENT`` bytes that end a phrase. All segments of an
Arrow batch walk side by side: a step of the walk is one table lookup for all of them.

The sample is bounded and documented: ``sample_rows`` rows a language, those with the least text hash, ``sample_chars`` characters of each at most, ``train_bytes`` normalised bytes
a language, and ``model_bytes`` bytes over all languages. Only the sample (not the tables) goes to the workers; each worker builds the
automata once.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if no row can be learned from. The score is the lead over the second
language, 1 - best / second, and 1 if only one language is known. Null ids count as the empty string (not held out). Repeated rows are judged alike. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 512
#: Bytes of text that are parsed at once in a worker; longer texts are cut into segments like all others, in several rounds.
BLOCK = 1 << 22
PAD = 255  # never a byte of UTF-8
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter or mark that stands for it, or a space."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point))[0] in "LM":
            low = chr(point).lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(point))[0] == "L" for point in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def normal(text: str) -> bytes:
    """Lower-case letters and marks with single spaces between; empty if there is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not _is_letter()[points].any():
        return b""
    own = _letters()[points]
    blank = own == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return own[keep].tobytes().decode("utf-32-le").strip(" ").encode()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``; state 0 is the root and every state accepts."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in data:
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return moves


class Parser:
    """The automaton of one language as a table of steps.

    Entry (state, symbol) is the next state, times the table's width; a step that begins a phrase is negative. State 0 is the root, so
    states are counted from 1 here. Bytes that the sample doesn't hold share one symbol: a phrase of their own.
    """

    def __init__(self, sample: bytes):
        moves = suffix_automaton(sample)
        known = sorted(set(sample))
        self.bits = math.log2(max(len(sample), 2))
        self.width = width = len(known) + 2
        self.symbol = np.full(256, len(known), np.int64)
        self.symbol[known] = np.arange(len(known))
        self.symbol[PAD] = len(known) + 1
        start = np.full(width, -width, np.int32)  # an unknown byte leads back to the root
        for c, s in moves[0].items():
            start[self.symbol[c]] = -(s + 1) * width
        table = np.tile(start, (len(moves) + 1, 1))
        sizes = np.fromiter(map(len, moves), np.int64, len(moves))
        owner = np.repeat(np.arange(len(moves)), sizes)
        symbols = self.symbol[np.fromiter((c for m in moves for c in m), np.int64, sizes.sum())]
        targets = np.fromiter((s for m in moves for s in m.values()), np.int64, sizes.sum())
        inner = owner > 0
        table[owner[inner] + 1, symbols[inner]] = (targets[inner] + 1) * width
        table[:, width - 1] = np.arange(len(moves) + 1) * width  # padding changes nothing
        self.table = table.ravel()

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases of each segment; ``columns`` holds one byte of every segment per row."""
        state = np.full(columns.shape[1], self.width, np.int64)
        count = np.zeros(columns.shape[1], np.int32)
        for step in self.symbol[columns]:
            step += state
            state = self.table.take(step)
            count += state < 0
            np.abs(state, out=state)
        return count


@lru_cache(2)
def _parsers(samples: tuple[tuple[str, bytes], ...]) -> tuple[Parser, ...]:
    return tuple(Parser(sample) for _, sample in samples)


def phrase_counts(texts: list[bytes], parsers: tuple[Parser, ...]) -> np.ndarray:
    """Phrases of every text (rows) against every parser (columns)."""
    out = np.zeros((len(texts), len(parsers)), np.int64)
    first = 0
    while first < len(texts):
        size, last = 0, first
        while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK):
            size += len(texts[last])
            last += 1
        sizes = np.fromiter(map(len, texts[first:last]), np.int64, last - first)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(first, last), pieces)
        data = b"".join(t + bytes([PAD]) * (-len(t) % SEGMENT) for t in texts[first:last])
        rows = np.frombuffer(data, np.uint8).reshape(-1, SEGMENT)
        for low in range(0, len(rows), BLOCK // SEGMENT):  # a text longer than a block takes several
            part = slice(low, low + BLOCK // SEGMENT)
            columns = np.ascontiguousarray(rows[part].T)
            for k, parser in enumerate(parsers):
                np.add.at(out[:, k], owner[part], parser.phrases(columns))
        first = last
    return out


def predict(texts: list[str | None], samples: tuple[tuple[str, bytes], ...]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    bodies = [normal(t) if t else b"" for t in texts]
    if not samples:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    parsers = _parsers(samples)
    need = phrase_counts(bodies, parsers) * np.array([p.bits for p in parsers])
    order = np.argsort(need, axis=1, kind="stable")
    at = np.arange(len(texts))
    best = need[at, order[:, 0]]
    second = need[at, order[:, 1]] if len(parsers) > 1 else np.where(best > 0, np.inf, 0)
    score = np.where(second > 0, 1 - best / np.where(second > 0, second, 1), 0.0)
    return ([samples[k][0] if b else UNKNOWN for k, b in zip(order[:, 0], bodies)], [float(s) if b else 0.0 for s, b in zip(score, bodies)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 64, sample_chars: int = 4096,
                     train_bytes: int = 1 << 15, model_bytes: int = 1 << 21) -> tuple[tuple[str, bytes], ...]:
    """(language, normalised sample) by language, from labelled rows that aren't held out; the rows with the least text hash are taken."""
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.col(text_col) != ""))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"), F.left(F.col(text_col), F.lit(sample_chars)).alias("body"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "body"))
    # The row number is limited within each task before the shuffle, so a frequent language sends no more than others.
    taken = rows.withColumn("place", place).filter(F.col("place") <= sample_rows).collect()
    by_lang: dict[str, list] = {}
    for r in taken:
        by_lang.setdefault(r["lang"], []).append(r)
    size = min(train_bytes, model_bytes // max(len(by_lang), 1))
    out = []
    for lang in sorted(by_lang):
        bodies = (normal(r["body"]) for r in sorted(by_lang[lang], key=lambda r: r["place"]))
        sample = b"\0".join(b for b in dict.fromkeys(bodies) if b)[:size]  # no match crosses from row to row
        if sample:
            out.append((lang, sample))
    return tuple(out)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", samples: tuple | None = None, **sampling) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. ``samples`` may come from ``training_samples`` of another table."""
    if samples is None:
        samples = training_samples(docs, id_col, text_col, lang_col, **sampling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(batch.column(2).to_pylist(), samples)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
