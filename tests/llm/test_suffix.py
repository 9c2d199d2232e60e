import hashlib
import random

import pytest

from career_index.llm import suffix

SCHEMA = "doc_id long, text string, h int, spans string"


def brute(rows, length):
    """By id: (n_bytes, n_removed, n_spans, kept hash); rows hold each document once."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def got(spark, rows, length):
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], SCHEMA)
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix.remove_repeats(df, length=length).collect()]


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "zebra", "éclair", "running", "x", "lorem"] + [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [some(rng.randrange(8, 50)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice([some(rng.randrange(30)), rng.choice(shared), rng.choice(shared)[rng.randrange(20):]]) for _ in range(rng.randrange(6))]
        rows.append((i * 3, " ".join(parts)))
    near = rows[7][1].replace("the", "teh", 1)
    return [*rows, (500, rows[5][1]), (501, rows[5][1]), (502, near), (503, None), (504, ""), (505, "a" * 700), (506, "ab" * 90 + "a" * 150), (None, shared[0] * 3)]


@pytest.mark.parametrize(("seed", "length"), [(1, 40), (2, 64), (3, 100)])
def test_matches_brute_force(spark, seed, length):
    rows = texts(seed)
    assert dict(got(spark, rows, length)) == brute(rows, length)


def test_salted_groups_match_brute_force(spark, monkeypatch):
    rows = texts(4)
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (100, 2))
    assert dict(got(spark, rows, 40)) == brute(rows, 40)


def test_buckets_equal_strings():
    rng = random.Random(9)
    import numpy as np

    data = bytes(rng.choice(b"ab\xff") for _ in range(400))
    for length in (3, 8, 13, 40):
        ids = suffix.refine(np.frombuffer(data, np.uint8), length)
        strings = [data[k:k + length] for k in range(len(data) - length + 1)]
        assert len(ids) == len(strings)
        assert len(set(zip(ids.tolist(), strings, strict=True))) == len(set(strings)) == len(set(ids.tolist()))


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = got(spark, [(1, text), (1, text), (2, text), (2, "short")], 100)
    n = len(text)
    assert sorted((i, v[0], v[1]) for i, v in rows) == [(1, n, 0), (1, n, 0), (2, 5, 0), (2, n, n)]
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
