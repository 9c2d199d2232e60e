"""Best-fit packing of tokenised documents into sequences of one length (operator 2).

How many pieces of each length there are decides the plan; which document they come from doesn't. The driver therefore
plans on the histogram of lengths, at most ``capacity`` rows however large the corpus is:

* Lengths above a third of the capacity are matched greedily, longest first with the longest partner that
  still fits; at most two of them share a sequence.
* The other lengths go, longest first, into the sequence whose gap fits best; runs of equal sequences are filled as one step.

The plan is a table of segments: pieces of one length with ranks from..to take these sequences and offsets. Pieces are
ranked within their length in parallel: each length is dealt over salts, the counts per (length, salt) give the offsets.

Defined results: null text equals empty text, which is the single piece [end id]. A text longer than the capacity is cut
into pieces of the capacity; the last may be shorter. Rows with equal id are separate documents. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from career_index.llm.common import materialize, text_or_empty

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, WordEncoder] = {}


#: The tokens before merging of a folded word without white space. Every character above ASCII is taken for a letter here.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u0080-\U0010ffff]+|[0-9]|[^a-z0-9\u0080-\U0010ffff]+")
#: Texts are looked up together until they have so many characters.
_CHUNK = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenisers write each byte: itself if it is visible in Latin-1, else the next free code point from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


def simplified(text: str) -> str:
    """A text with the same tokens and fewer distinct words.

    Case is dropped by the tokeniser anyhow. It is only folded here where that commutes with the tokeniser's own NFC and
    character-wise folding.
    """
    low = text.lower()
    if not text.isascii() and ("\u03a3" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", low)):
        return text
    return low


def _plain(part: str) -> bool:
    """The tokeniser's normaliser and splitter leave this part of a folded word as it is."""
    return part.isascii() or (part.isalpha() and part.islower() and unicodedata.is_normalized("NFC", part))


class WordEncoder:
    """Little-endian 32-bit ids of texts, word by word, with a bounded cache of words.

    No token of this tokeniser spans white space, so the ids of a text are those of its words. Arrow splits many texts at once and
    numbers their distinct words; only words that are not in the cache are tokenised. A text that holds the literal of a
    special token goes to the tokeniser whole, which reads the literal as that token.
    """

    def __init__(self, path: str, cache_limit: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.literals = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.cache_limit = cache_limit

    def merged(self, part: str) -> bytes:
        raw = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Make all ``words`` known. Where the cache gets too large, the words of earlier texts that are not among them leave it."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.cache_limit:
            self.known = known = {w: known[w] for w in words if w in known}
        rest = []
        for w in new:
            low = w.lower()
            parts = [low] if low.isalpha() else _PARTS.findall(low)
            if low != w and not w.isascii() or not all(map(_plain, parts)):
                rest.append(w)
            elif len(parts) == 1:
                known[w] = self.merged(low)
            else:
                known[w] = b"".join([known[p] if p in known else known.setdefault(p, self.merged(p)) for p in parts])
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def look_up(self, texts: list[str]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        found = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        word = numbered.indices.to_numpy()
        ends = np.cumsum(sizes[word])
        at = np.arange(ends[-1]) + np.repeat(starts[word] - ends + sizes[word], sizes[word])
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        bounds = 4 * np.concatenate(([0], ends))[split.offsets.to_numpy()]
        for first, last in pairwise(bounds.tolist()):
            yield ids[first:last]

    def encode(self, texts) -> Iterator[bytes]:
        for chunk in chunks(texts, _CHUNK):
            low = [t.lower() for t in chunk]
            whole = {k for k, t in enumerate(low) if any(x in t for x in self.literals)}
            for k, ids in enumerate(self.look_up(["" if k in whole else simplified(t) for k, t in enumerate(chunk)])):
                yield array("I", self.tokenizer.encode(chunk[k], add_special_tokens=False).ids).tobytes() if k in whole else ids


def chunks(texts, size: int) -> Iterator[list[str]]:
    """The texts in lists that end once they have ``size`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for b in batches:
            out = []
            texts = (t.as_py() for t in b.column("body"))
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(texts), strict=True):
                ids += end
                step = 4 * capacity
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
    return rows.mapInArrow(run, _PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(sequences, [(length, times), ...])]: each entry is a number of sequences filled alike."""
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    runs: list[tuple[int, int, tuple]] = []  # gap, sequences, contents
    for s in large:
        while left[s]:
            partner = next((t for t in large if t <= capacity - s and t <= s and left[t] > (t == s)), None)
            if partner is None:
                runs.append((capacity - s, left[s], ((s, 1),)))
                left[s] = 0
            elif partner == s:
                runs.append((capacity - 2 * s, left[s] // 2, ((s, 2),)))
                left[s] %= 2
            else:
                k = min(left[s], left[partner])
                runs.append((capacity - s - partner, k, ((s, 1), (partner, 1))))
                left[s] -= k
                left[partner] -= k
    open_runs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    done: list[tuple[int, tuple]] = []
    gaps: list[int] = []

    def put(gap: int, n: int, held: tuple) -> None:
        if not gap:
            done.append((n, held))
            return
        if not open_runs[gap]:
            heapq.heappush(gaps, gap)
        open_runs[gap].append((n, held))

    for gap, n, held in runs:
        put(gap, n, held)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[s]:
            fit = min((g for g in gaps if g >= s and open_runs[g]), default=None)
            if fit is None:
                per = capacity // s
                full, rest = divmod(left[s], per)
                if full:
                    put(capacity - per * s, full, ((s, per),))
                if rest:
                    put(capacity - rest * s, 1, ((s, rest),))
                left[s] = 0
                continue
            n, held = open_runs[fit].pop()
            if not open_runs[fit]:
                gaps.remove(fit)
                heapq.heapify(gaps)
            per = min(fit // s, left[s])
            k = min(n, left[s] // per)
            if k < n:
                put(fit, n - k, held)
            put(fit - per * s, k, (*held, (s, per)))
            left[s] -= k * per
    return [(n, list(held)) for n, held in done] + [(n, list(held)) for g in list(open_runs) for n, held in open_runs[g]]


def segments(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by (length, rank): arrays length, first (rank), base (sequence), times, offset, sorted by length and rank."""
    used: Counter = Counter()
    rows, base = [], 0
    for n, held in runs:
        offset = 0
        for s, times in held:
            rows.append((s, used[s], base, times, offset))
            used[s] += n * times
            offset += s * times
        base += n
    table = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "times", "offset"), table.T, strict=True))


def ranked(parts: DataFrame, salts: int) -> DataFrame:
    """``parts`` with ``rank``, from 0 within each length. A frequent length is dealt over ``salts`` tasks."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    out = salted.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "salt"])
    return out.withColumn("rank", F.col("lower") + F.col("own"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         rows_per_salt: int = 500_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Offsets are gapless from 0 in each sequence."""
    parts = materialize(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    slots = segments(plan(histogram, capacity))
    salts = max(64, -(-sum(histogram.values()) // rows_per_salt))

    def place(batches):
        keys = slots["length"].astype(np.uint64) << np.uint64(48) | slots["first"].astype(np.uint64)
        for pdf in batches:
            key = pdf["length"].to_numpy().astype(np.uint64) << np.uint64(48) | pdf["rank"].to_numpy().astype(np.uint64)
            at = np.searchsorted(keys, key, side="right") - 1
            step = pdf["rank"].to_numpy() - slots["first"][at]
            within, turn = np.divmod(step, slots["times"][at])
            out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"] = slots["base"][at] + within
            out["offset"] = slots["offset"][at] + turn * pdf["length"].to_numpy()
            yield pd.DataFrame(out)

    rows = ranked(parts, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(place, f"{_PIECES}, sequence_id long, offset long")
