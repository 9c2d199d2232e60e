"""Byte-level BPE encoding and decoding with a segment tree (operator 3).

A text is split by the pattern of the vocabulary; each match is encoded by itself. Over the byte positions of a match
stands a segment tree whose leaves hold the rank of the pair that begins there, and whose nodes hold the smallest
rank below together with the leftmost position that has it. The root gives the next merge; a merge changes the pair of its
own position, of the live neighbour on its left, and removes that of the neighbour on its right: three point
updates of logarithmic cost.

Matches of similar length are worked on side by side, one row of arrays each, so that a merge step is a few numpy
operations for thousands of matches. Ids of whole words go into a bounded cache of the worker, since words repeat.

Defined results: null text equals empty text, which has no tokens. Every row is encoded by itself, so repeated rows
and null ids need no care. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import text_or_empty

_FAR = np.int64(1) << 62
_LOADED: dict[tuple[str, str], ByteBPE] = {}


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, ranks_path: str, pattern: str, cache_limit: int = 500_000):
        with open(ranks_path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.find = regex.compile(pattern).findall
        self.odd_space = regex.compile(r"\s | \s").search
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_limit = cache_limit
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.bytes_of) + 1
        self.pairs = pairs = {}
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = r
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_key.tolist()], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _FAR where they don't merge or the right one is missing (-1)."""
        if not len(self.pair_key):
            return np.full(len(left), _FAR)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (right >= 0), self.pair_rank[at], _FAR)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; all pieces fit a tree of the same width."""
        n, width = len(pieces), 1 << max(1, math.ceil(math.log2(max(map(len, pieces)))))
        length = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_id[flat]
        place = np.arange(width)
        ids[place[None, :] >= length[:, None]] = -1
        right = np.broadcast_to(place + 1, (n, width)).copy()  # the live position after each; width: none
        left = np.broadcast_to(place - 1, (n, width)).copy()
        # A node is rank * width + position, so its minimum is the smallest rank at its leftmost position.
        tree = np.full((n, 2 * width), _FAR)
        first = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width:2 * width - 1] = np.where(first < _FAR, first * width + place[:-1], _FAR)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        nodes = tree.reshape(-1)

        def update(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            start, node = row * (2 * width), at + width
            nodes[start + node] = value
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                child = start + 2 * node
                nodes[start + node] = np.minimum(nodes[child], nodes[child + 1])

        def pair(row: np.ndarray, at: np.ndarray) -> np.ndarray:
            after = right[row, at]
            other = np.where(after < width, ids[row, np.minimum(after, width - 1)], -1)
            rank = self._ranks(ids[row, at], other)
            return np.where(rank < _FAR, rank * width + at, _FAR)

        row = np.flatnonzero(tree[:, 1] < _FAR)
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = right[row, at]
            after = right[row, gone]
            ids[row, at] = rank
            ids[row, gone] = -1
            right[row, at] = after
            inner = after < width
            left[row[inner], after[inner]] = at[inner]
            update(row, gone, np.full(len(row), _FAR))
            update(row, at, pair(row, at))
            before = left[row, at]
            own = before >= 0
            if own.any():
                update(row[own], before[own], pair(row[own], before[own]))
            row = row[tree[row, 1] < _FAR]
        counts = (ids >= 0).sum(axis=1)
        kept = ids[ids >= 0].tolist()
        ends = np.cumsum(counts).tolist()
        return [tuple(kept[e - c:e]) for e, c in zip(ends, counts.tolist(), strict=True)]

    def merge_one(self, piece: bytes) -> tuple[int, ...]:
        """As ``merge`` for a single piece, with plain lists: better for a few long ones."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [self.rank[piece[k:k + 1]] for k in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        far = (int(_FAR), n)

        def pair(at: int) -> tuple[int, int]:
            after = right[at]
            rank = self.pairs.get(ids[at] * self.base + ids[after]) if after < n else None
            return far if rank is None else (rank, at)

        tree = [far] * (2 * width)
        tree[width:width + n] = [pair(k) for k in range(n)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: tuple[int, int]) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] != far:
            rank, at = tree[1]
            gone = right[at]
            after = right[at] = right[gone]
            ids[at], ids[gone] = rank, -1
            if after < n:
                left[after] = at
            update(gone, far)
            update(at, pair(at))
            if left[at] >= 0:
                update(left[at], pair(left[at]))
        return tuple(i for i in ids if i >= 0)

    def ids_of(self, matches: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each match; matches of one tree width are merged side by side."""
        groups: dict[int, list[str]] = {}
        for m in matches:
            groups.setdefault(max(1, (len(m.encode()) - 1).bit_length()), []).append(m)
        out = {}
        for bits, members in groups.items():
            if len(members) < 16:
                out.update((m, self.merge_one(m.encode())) for m in members)
                continue
            step = max(1, (1 << 18) >> bits)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                out.update(zip(part, self.merge([m.encode() for m in part]), strict=True))
        return out

    def learn(self, words: set[str]) -> None:
        """Bring the ids of words into the cache."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.cache_limit:
            self.cache.clear()
            new = list(words)
        found = [self.find(w) for w in new]
        ids = self.ids_of(set(chain.from_iterable(found)))
        self.cache.update((w, tuple(chain.from_iterable(map(ids.__getitem__, f)))) for w, f in zip(new, found, strict=True))

    def words(self, text: str) -> list[str]:
        """Parts of the text between which the pattern always splits: at a space with no white space beside it.

        Such a space opens the match of what follows it. A text with other spaces is a single part.
        """
        if text[:1] == " " or text[-1:] == " " or self.odd_space(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        parts = [self.words(t) for t in texts]
        self.learn({w for p in parts for w in p})
        return [list(chain.from_iterable(map(self.cache.__getitem__, p))) for p in parts]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def loaded(ranks_path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process, kept with its cache."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = ByteBPE(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def _parts(column: pa.Array, chars: int = 1 << 20):
    """Texts in groups of about ``chars``, so that memory follows the longest text and not the batch."""
    part, held = [], 0
    for t in column:
        part.append(t.as_py())
        held += len(part[-1])
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            ids = [i for part in _parts(b.column("body")) for i in bpe.encode(part)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded: binary) for each row of (doc_id, ids); null ids decode to nothing."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            raw = [bpe.decode(i.as_py() or []) for i in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: encoded, and decoded from the ids, in one pass."""

    def run(batches):
        bpe = loaded(ranks_path, pattern)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for part in _parts(b.column("body")):
                for ids in bpe.encode(part):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
