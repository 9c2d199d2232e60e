"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from career_index.llm import spelling

DOCS = "doc_id long, text string, word string, n int, root int"


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), c, len(near[w]), n[form[w]] if form[w] else -1) for w, c in n.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def fixture(letters, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(25)]

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + rng.choice(letters) + w[k:]])

    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(60)):
            w = base[min(int(rng.expovariate(0.3)), 24)]
            for _ in range(rng.choice([0] * 30 + [1, 1, 2])):
                w = edited(w)
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", "-", "9", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("letters,seed,shard_words", [("ab", 1, 1 << 16), ("abcé", 2, 400), ("aÿÀ×", 3, 60), ("abcdefghijklmnopqrstuvwxyz", 4, 1 << 16)])
def test_equals_brute_force(spark, letters, seed, shard_words):
    rows = fixture(letters, seed)
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS).repartition(3)
    out = got(spelling.group_variants(docs, shard_words=shard_words))
    assert out == brute(rows)
    assert any(r[4] for r in out)


def test_forms_and_roots_chain(spark):
    rows = [(1, "weather " * 2 + "weathers " * 20 + "weatherst " * 400), (None, "weatherst"), (2, None), (3, ""), (4, "x" * 300_000 + " " + "x" * 300_000)]
    rows += [rows[0], (5, "İstanbul ŒUVRES12abcdefg")]
    docs = spark.createDataFrame([(*r, "", 1, 2) for r in rows], DOCS)
    out = got(spelling.group_variants(docs))
    assert out == brute(rows)
    assert {r[0]: r[2] for r in out}["weather"] == "weatherst"


def test_no_near_words(spark):
    rows = [(1, "aaaaaaaa aaaaaaaa bbbbbbbbbb bbbbbbbbbb")]
    out = got(spelling.group_variants(spark.createDataFrame([(*r, "", 1, 2) for r in rows], DOCS)))
    assert out == brute(rows) and len(out) == 2


def test_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_rank_intervals_stay_in_step():
    """The second interval of every exact search is the range of words with that beginning."""
    import numpy as np
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    index = spelling.Direction(words)
    symbol = {chr(p): k + 1 for k, p in enumerate(index.alphabet)}
    for _ in range(200):
        w = rng.choice(words)
        part = w[:rng.randrange(len(w) + 1)]
        low, high, rank = np.array([0]), np.array([len(words)]), np.array([0])
        for c in part:
            low, high, rank = index.extend(np.array([symbol[c]]), low, high, rank)
        inside = [k for k, x in enumerate(words) if x.startswith(part)]
        assert (rank[0], high[0] - low[0]) == (inside[0], len(inside))


def test_ratio_that_could_cycle_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], DOCS), ratio=1)
