"""Language identification: the parse against a plain one, and held-out accuracy."""

import random
import zlib

import numpy as np

from career_index.llm import langid
from career_index.sources.tables import table

DOCS = "doc_id long, text string, lang string, source string, score string"


def plain_phrases(text, sample):
    """Longest-match phrases, segment by segment, by searching the sample itself."""
    total = 0
    for low in range(0, len(text), langid.SEGMENT):
        piece = text[low:low + langid.SEGMENT]
        at = 0
        while at < len(piece):
            end = at + 1
            while end < len(piece) and piece[at:end + 1] in sample:
                end += 1
            at, total = end, total + 1
    return total


def test_phrases_equal_plain_search():
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh ", "aé漢字 "):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
        samples = [text(400), text(50)]
        texts = [text(rng.choice([0, 1, 30, 511, 512, 513, 2000])) for _ in range(30)] + ["zzyé".encode()]
        found = langid.phrase_counts(texts, tuple(langid.Parser(s) for s in samples))
        assert found.tolist() == [[plain_phrases(t, s) for s in samples] for t in texts]


def test_long_text_over_several_blocks(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 2048)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (9000, 10, 3000, 0, 700)]
    sample = texts[0][:500]
    assert langid.phrase_counts(texts, (langid.Parser(sample),))[:, 0].tolist() == [plain_phrases(t, sample) for t in texts]


def test_normal():
    assert langid.normal("Été, 12 ÀB_c!\n") == "été àb c".encode()
    assert langid.normal("12 -- _ ́") == b""
    assert langid.normal("İ") == "İ".encode()  # lower case of two code points: kept
    assert langid.normal("नमस्ते दुनिया") == "नमस्ते दुनिया".encode()


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    away = [r for r in rows if r.held_out]
    assert len(away) > 200 and np.mean([r.lang == r.lang_pred for r in away]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_depends_on_text_alone(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    samples = langid.training_samples(docs)
    other = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, samples=samples).collect()}
    b = {r.doc_id - 1: (r.lang_pred, r.score) for r in langid.identify(other, samples=samples).collect()}
    assert a == b


def test_sample_is_bounded_and_holds_no_held_out_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    samples = langid.training_samples(docs, sample_rows=5, sample_chars=300, train_bytes=700)
    assert [x[0] for x in samples] == ["de", "en", "es", "fr"] and all(len(x[1]) <= 700 for x in samples)
    odd = spark.createDataFrame([(i, f"held out text {i} qqq" if zlib.crc32(str(i).encode()) % 4 == 2 else f"plain words {i}", "en", "", "") for i in range(60)], DOCS)
    assert b"qqq" not in langid.training_samples(odd)[0][1]


def test_defined_edges(spark):
    base = [(i, t, lang, None, "clash") for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran", "en"), ("der Hund und die Katze sind auf der Matte", "de")] * 8)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (None, "the cat ran", None), (103, "der Hund " * 30_000, None), (103, "der Hund " * 30_000, None),
           (104, "漢字", None)]
    docs = spark.createDataFrame(base + [(*r, None, "clash") for r in odd], DOCS)
    out = langid.identify(docs)
    rows = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert len(rows) == len(base) + len(odd)
    pred = {i: p for i, p, _ in rows}
    assert [pred[k] for k in (100, 101, 102, None, 103)] == ["und", "und", "und", "en", "de"]
    assert pred[104] in ("de", "en") and all(s == 0 for i, p, s in rows if p == "und")
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.filter("lang IS NULL")).collect()
    assert nothing and all(r.lang_pred == "und" for r in nothing)
