import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from career_index.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int, offset string"


def odd_texts():
    rng = random.Random(5)
    letters = "abcXYZ éÉßΣσçİ́̊K,.!_'’\"-\n\t\r\x1c\x85\xa0  0123日本🙂ﬁ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    return out + ["", "a", "it's,. 'S we'LL ...", "<|endoftext|> x", "a <|endoftext|> b", "a<|EndOfText|>b <|startoftext|>c", "<|STARTOFTEXT|>", "<|endoftext|>\u0338 ß", "<|endoftext", "Σ ΣΑΣ.", "x_,y", "a" * 300, "1,000.5", "Hello, World.\nNext, one."]


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_by_word_ids_equal_those_of_whole_texts():
    texts = odd_texts()
    for text, raw, ids in zip(texts, packing.WordEncoder(PATH, cache_limit=50).encode(texts), ids_of(texts), strict=True):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids, repr(text)


def check_layout(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for (doc_id, text), ids in zip(texts, ids_of([t or "" for _, t in texts]), strict=True):
        ids = [*ids, 0]
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        want = [ids[k:k + capacity] for k in range(0, len(ids), capacity)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [
            (k, k * capacity, len(w), zlib.crc32(struct.pack(f"<{len(w)}I", *w))) for k, w in enumerate(want)]
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in held) <= 2
    return len(by_seq)


@pytest.mark.parametrize("capacity", [16, 64])
def test_pieces_and_layout(spark, capacity):
    rng = random.Random(capacity)
    texts = [(k, " ".join(rng.choice(["the", "zebra", "of"]) for _ in range(rng.randrange(40)))) for k in range(300)] + [(300, None), (301, ""), (302, "a <|endoftext|> b")]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], SCHEMA)
    rows = packing.pack(df, PATH, capacity=capacity).collect()
    n = check_layout(rows, texts, capacity)
    assert n <= 1.1 * -(-sum(r.length for r in rows) // capacity) + 1


def test_plan_holds_every_piece_once():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randrange(3, 60)
        histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(200)))
        held = Counter()
        for n, contents in packing.plan(dict(histogram), capacity):
            assert sum(s * times for s, times in contents) <= capacity
            for s, times in contents:
                held[s] += n * times
        assert held == histogram


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", 1, "x"), (None, "a b", 1, "x"), (3, "c", 1, "x"), (3, "d", 1, "x")], SCHEMA)
    rows = packing.pack(df, PATH, capacity=8).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 3), (-1, 3), (3, 2), (3, 2)]
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_the_word_cache_of_a_worker_is_bounded():
    encoder = packing.WordEncoder(PATH)
    for at in range(0, 240_000, 8_000):
        list(encoder.encode([" ".join("w" + "".join(chr(97 + int(d)) for d in str(k)) for k in range(at, at + 8_000))]))
    assert len(encoder.known) <= 210_000


def test_ids_of_words_that_the_tokeniser_normalises():
    texts = ["\u1f7d a", "a\uf929 \u0393", "a\u0301 \u00c9S, x", "\xe9t\xe9,\xbb\xab\xe0.", "\x1d.a\xbb", "it's'S''s.'s 'RE'll \x0b\x7f", "K\u212b \u0130,\u00c9"]
    for text, raw, ids in zip(texts, packing.WordEncoder(PATH).encode(texts), ids_of(texts), strict=True):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids, ascii(text)


def test_words_with_punctuation_are_put_together_from_their_parts():
    texts = ["the word,### (word) the.\tword's x-y_z 1,000.5 \xe9t\xe9... WORD;the"] * 3
    encoder = packing.WordEncoder(PATH)
    encoder.tokenizer = None  # only the merges are needed
    for raw, ids in zip(encoder.encode(texts), ids_of(texts), strict=True):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ids


def test_words_in_use_stay_when_the_cache_is_full():
    encoder = packing.WordEncoder(PATH, cache_limit=100)
    encoder.learn(["often", *("w" + chr(97 + k % 26) * (k // 26 + 1) for k in range(95))])
    merged, asked, new = encoder.merged, [], [f"n{chr(97 + k)}" for k in range(10)]
    encoder.merged = lambda part: asked.append(part) or merged(part)
    encoder.learn(["often", *new])
    assert asked == new and len(encoder.known) <= 100
