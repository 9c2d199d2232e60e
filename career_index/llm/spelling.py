"""Spelling variants by bidirectional FM-index search schemes (operator 13).

Words are counted in the texts, and every word that occurs often enough joins the vocabulary. Two words are near if they are
one inserted, deleted or replaced code point apart. The error lies in one half of the longer word (either word, where lengths are equal), so the other half is exact:
one search matches the first half exactly and extends to the right, the other matches the second half and extends to the left, each
allowing one error.

The index of a direction holds the Burrows-Wheeler transform of the delimited vocabulary as a wavelet matrix. A search state is a
pair of synchronised suffix-rank intervals: the one it steps in, and that of the other direction, moved by the number of smaller symbols. It starts
with the delimiter, so halves are anchored at the word's end; when the delimiter at the far end is reached, the second interval is the word's own rank, and nothing
needs to be located. Searches to the left run on the mirrored words. All queries of a shard step side by side.

Each pair is found once. Of two words of equal length the one that is smaller at the error looks for the other; of two lengths the longer looks for the shorter, leaving out
a code point (of equal neighbours the last). Both directions are then counted.

Spark deals the vocabulary out by halves: words that can meet have an exact half in common, so each word goes, under three keys, to the shards of the
halves under which others look for it, and looks in the shards of its own two halves. A shard has about ``shard_words`` entries. Many small halves share a shard; a half with more
words than that is cut into blocks of index words and blocks of queries, each pair of blocks one shard, so every group has a bounded number of words and no pair is lost. Only counts and
the best near word leave a shard.

Defined results: null texts have no words; a null id counts as the empty string in the checksum; repeated rows count as often as they occur. Of equally frequent near words the first in code-point
order is the form. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from career_index.llm.common import materialize, release, small_side

LEAST_LENGTH = 7
DROP_EVERY = 31
_LETTERS = "a-zÀ-ÿ"
#: Words held back in a worker before they go out.
FLUSH = 1 << 17
#: Queries that search side by side.
ABREAST = 1 << 13

# ---------------------------------------------------------------------------- words


def _count_words(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of rows (id as text, text). Words of several batches are added up first."""
    run = re.compile(f"[{_LETTERS}]{{{least},}}")
    total: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            # Bytes fold A-Z only.
            low = (text or "").encode("utf-8", "replace").lower().decode()
            start = zlib.crc32(f"{doc_id}:".encode())
            found = Counter(run.findall(low)) if len(low) < 1 << 22 else Counter(m.group() for m in run.finditer(low))
            for word, n in found.items():
                h = zlib.crc32(word.encode(), start)
                if h % DROP_EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                    if len(word) < least:
                        continue
                total[word] += n
            if len(total) >= FLUSH:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = 2) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_length`` code points and ``least_count`` occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = rows.mapInArrow(lambda batches: _count_words(batches, least_length), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------------------- index


def _ranks(first: np.ndarray) -> np.ndarray:
    """Suffix ranks of a text by doubling, from symbols of which every delimiter is its own."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    step = 1
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[0, first[order][1:] != first[order][:-1]])
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        step *= 2
    return rank


class Direction:
    """FM-index of a sorted vocabulary for steps to the right: one interval in the mirrored text, one among the words.

    Symbol 0 is the delimiter. Rows are the prefixes of the words, sorted from their ends; the transform holds the symbol that follows each.
    """

    def __init__(self, words: list[str]):
        self.words = words
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        self.lengths, self.start = lengths, np.cumsum(lengths) - lengths
        self.symbols = symbols.astype(np.int64) + 1
        self.levels = max(int(len(self.alphabet)).bit_length(), 1)
        # Mirrored words, each with its delimiter behind it.
        begin = self.start + np.arange(len(words))
        total = int(lengths.sum()) + len(words)
        place = np.repeat(begin, lengths) + np.repeat(lengths, lengths) - 1 - (np.arange(len(points)) - np.repeat(self.start, lengths))
        mirrored = np.zeros(total, np.int64)
        mirrored[place] = self.symbols
        after = np.zeros(total, np.int64)  # what follows the prefix that begins here in the mirrored text
        after[1:] = mirrored[:-1]
        unique = mirrored + len(words) - 1
        unique[begin + lengths] = np.arange(len(words))
        rank = _ranks(unique)
        transform = np.empty(total, np.int64)
        transform[rank] = after
        self.before = np.r_[0, np.cumsum(np.bincount(mirrored, minlength=1 << self.levels))][: 1 << self.levels]
        self._wavelet(transform)

    def _wavelet(self, symbols: np.ndarray) -> None:
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.r_[symbols[bit == 0], symbols[bit == 1]]
        start, _, _ = self._descend(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64), np.zeros(1 << self.levels, np.int64))
        self.shift = self.before - start

    def _descend(self, symbol, low, high):
        """Bounds of the symbol below the wavelet matrix, and the number of smaller symbols in the interval."""
        less = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            low1, high1 = self.ones[k][low], self.ones[k][high]
            less += np.where(one, (high - high1) - (low - low1), 0)
            low = np.where(one, self.zeros[k] + low1, low - low1)
            high = np.where(one, self.zeros[k] + high1, high - high1)
        return low, high, less

    def extend(self, symbol, low, high, rank):
        """One step to the right; an interval may come out empty."""
        low, high, less = self._descend(symbol, low, high)
        return low + self.shift[symbol], high + self.shift[symbol], rank + less

    def branches(self, above, low, high, rank):
        """(which state, symbol, low, high, rank) for every symbol greater than ``above`` that follows a state's interval."""
        which = np.arange(len(low))
        symbol = np.zeros(len(low), np.int64)
        for k in range(self.levels):
            rest = self.levels - 1 - k
            low1, high1 = self.ones[k][low].astype(np.int64), self.ones[k][high].astype(np.int64)
            low0, high0 = low - low1, high - high1
            zero = (high0 > low0) & ((((symbol << 1) + 1) << rest) - 1 > above[which])
            one = (high1 > low1) & (((symbol + 1) << (rest + 1)) - 1 > above[which])
            less = rank + high0 - low0
            which, symbol, low, high, rank = (np.r_[which[zero], which[one]], np.r_[symbol[zero] << 1, symbol[one] << 1 | 1],
                                              np.r_[low0[zero], self.zeros[k] + low1[one]], np.r_[high0[zero], self.zeros[k] + high1[one]],
                                              np.r_[rank[zero], less[one]])
        return which, symbol, low + self.shift[symbol], high + self.shift[symbol], rank

    def near(self, query: np.ndarray, exact: np.ndarray, second: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all near pairs with the error behind the first ``exact`` symbols.

        ``second``: the words are mirrored. Of equal neighbours the last in reading order is left out, so that a pair is found once.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, len(query), ABREAST):
            some = slice(first, first + ABREAST)
            self._near(query[some], exact[some], second, found)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _symbol(self, query, at):
        """Symbol of the query's word at a place; the delimiter behind its end."""
        inside = at < self.lengths[query]
        return np.where(inside, self.symbols[np.minimum(self.start[query] + at, len(self.symbols) - 1)], 0)

    def _near(self, query, exact, second, found) -> None:
        n = len(query)
        low, high, rank = np.zeros(n, np.int64), np.full(n, len(self.words), np.int64), np.zeros(n, np.int64)
        at = np.zeros(n, np.int64)
        held = []  # states past their error: query, place, low, high, rank
        while len(query):
            inside = (at >= exact) & (at < self.lengths[query])
            q, i, lo, hi, rk = query[inside], at[inside], low[inside], high[inside], rank[inside]
            own = self._symbol(q, i)
            # A code point left out: go on behind it from the same state.
            beside = np.where(i > 0, self._symbol(q, np.maximum(i - 1, 0)), 0) if second else self._symbol(q, i + 1)
            last = own != beside
            held.append((q[last], i[last] + 1, lo[last], hi[last], rk[last]))
            which, _, lo, hi, rk = self.branches(own, lo, hi, rk)
            held.append((q[which], i[which] + 1, lo, hi, rk))
            # The exact path.
            low, high, rank = self.extend(self._symbol(query, at), low, high, rank)
            at = at + 1
            go = (high > low) & (at < self.lengths[query])
            query, exact, at, low, high, rank = query[go], exact[go], at[go], low[go], high[go], rank[go]
            self._finish(held, found)
            held = []

    def _finish(self, held, found) -> None:
        """Match states past their error up to and with the far delimiter."""
        query, at, low, high, rank = (np.concatenate(x) for x in zip(*held))
        while len(query):
            low, high, rank = self.extend(self._symbol(query, at), low, high, rank)
            at = at + 1
            alive = high > low
            done = alive & (at > self.lengths[query])
            if done.any():
                found.append((query[done], rank[done]))
            go = alive & ~done
            query, at, low, high, rank = query[go], at[go], low[go], high[go], rank[go]


# ---------------------------------------------------------------------------- shards


SHARD_RESULT = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_counts(group: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of one shard: rows (side, word, n, own).

    ``own``: bit 1, the row is an index word; bit 2, a query. Blocks of a large half hold rows with one bit only, so a word can come twice.
    """
    out: dict[str, list] = {name: [] for name in SHARD_RESULT.names}
    for mirrored in (False, True):
        rows = group.filter(pa.compute.equal(group["side"], int(mirrored)))
        if not rows.num_rows:
            continue
        texts = rows["word"].to_pylist()
        keys = np.array([t[::-1] if mirrored else t for t in texts], object)
        words, at = np.unique(keys, return_inverse=True)
        mask, freq = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        np.bitwise_or.at(mask, at, rows["own"].to_numpy())
        freq[at] = rows["n"].to_numpy()
        index = Direction(words.tolist())
        query = np.flatnonzero(mask & 2)
        half = index.lengths[query] // 2
        a, b = index.near(query, np.where(mirrored, index.lengths[query] - half, half), mirrored)
        good = (mask[b] & 1) == 1
        a, b = a[good], b[good]
        if not len(a):
            continue
        plain = np.array([w[::-1] for w in words], object) if mirrored else words
        place = np.empty(len(words), np.int64)
        place[np.argsort(plain, kind="stable")] = np.arange(len(words))  # Python compares by code points
        left, right = np.r_[a, b], np.r_[b, a]
        order = np.lexsort((place[right], -freq[right], left))
        left, right = left[order], right[order]
        head = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
        for name, values in zip(out, (plain[left[head]], np.diff(np.r_[head, len(left)]), freq[right[head]], plain[right[head]])):
            out[name] += values.tolist()
    return pa.table(out, SHARD_RESULT)


def _entries(words: DataFrame) -> DataFrame:
    """(side, half, word, n, own): the halves under which a word is found (1), looks for others (2), or both (3)."""
    length = F.length("word")

    def half(side: int, size: Column) -> tuple[Column, Column]:
        first = F.floor(size / 2).cast("int")
        return (F.substring(F.col("word"), F.lit(1), first) if side == 0 else F.right(F.col("word"), size - first)), first if side == 0 else size - first

    rows = []
    for side in (0, 1):
        own, own_size = half(side, length)
        longer, longer_size = half(side, length + 1)  # where words that are one longer look
        entry = lambda text, mark: F.struct(F.lit(side).alias("side"), text.alias("half"), F.lit(mark).alias("own"))
        rows += [entry(own, 3), F.when(own_size != longer_size, entry(longer, 1))]
    return words.select("word", "n", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("e.*", "word", "n")


def _dealt(entries: DataFrame, shard_words: int) -> DataFrame:
    """(shard, side, word, n, own): every entry with its shard, or with several where a half is cut into blocks; a partition holds few shards."""
    sizes = entries.groupBy("side", "half").agg(F.count(F.lit(1)).alias("size"))
    total = entries.count()
    shards = max(-(-total // shard_words), 1)
    # At most total / shard_words halves are this large.
    large = small_side(materialize(sizes.filter(F.col("size") > shard_words), "spelling-large"))
    rows = entries.join(large, ["side", "half"], "left")
    blocks = F.ceil(F.col("size") / shard_words).cast("int")
    block = F.pmod(F.xxhash64("word"), blocks)
    every = F.sequence(F.lit(0), blocks - 1)
    name = lambda i, j: F.concat_ws(":", F.col("side").cast("string"), "half", i.cast("string"), j.cast("string"))
    as_word = F.transform(every, lambda j: F.struct(name(block, j).alias("shard"), F.lit(1).alias("own")))
    as_query = F.when(F.col("own") == 3, F.transform(every, lambda i: F.struct(name(i, block).alias("shard"), F.lit(2).alias("own"))))
    small = F.array(F.struct(F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("string").alias("shard"), F.col("own")))
    places = F.when(F.col("size").isNull(), small).otherwise(F.concat(as_word, F.coalesce(as_query, F.array().cast("array<struct<shard:string,own:int>>"))))
    dealt = rows.select(F.explode(places).alias("p"), "side", "word", "n").select("p.*", "side", "word", "n")
    return dealt.repartition(min(2 * shards, 10_000), "shard")  # few bytes but much work: not to be joined into few partitions


def near_words(words: DataFrame, shard_words: int = 1 << 16) -> DataFrame:
    """(word, n_near, best): for every word of (word, n) that has one, the number of near words and the most frequent of them."""
    dealt = _dealt(_entries(words), shard_words)
    found = dealt.groupBy("shard").applyInArrow(lambda group: near_counts(group), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def _roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of (word, form): every hop is at least tenfold in frequency, so doubling ends after a few rounds."""
    known = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        step = known.join(known.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not step.filter("moved").isEmpty()
        release(known)
        known = step.select("word", "root")
        if not moved:
            return known
    raise RuntimeError(f"forms did not settle in {max_rounds} rounds")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = 2, ratio: int = 10,
                   shard_words: int = 1 << 16) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n. A form is at least ``ratio`` times as frequent as the word."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could point at each other")
    words = materialize(vocabulary(docs, id_col, text_col, least_length, least_count), "spelling-words")
    near = materialize(near_words(words, shard_words), "spelling-near")
    rows = words.join(near, "word", "left")
    takes = F.col("best_n") >= ratio * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best")).alias("form"),
                                   F.when(takes, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
