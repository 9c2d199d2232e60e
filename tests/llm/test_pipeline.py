"""The pipeline on a fixture whose outcome is known row by row, and against a plain version of all its stages."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from test_substring import brute as plain_cut
from tokenizers import Tokenizer

import corpus_pipeline
from career_index.llm import simhash


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."
    passage, a, b, c = prose(60), prose(300), prose(300), prose(300)
    near = c.replace(c.split()[150], "changed", 1)
    rows = [(1, a), (2, f"{b}\n{passage}"), (3, a), (4, c), (5, near), (6, f"{passage}\n{prose(200)}"), (7, "few words"), (8, "# $ % & " * 100), (9, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept == [[1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6], [2, 3, 4, 6], [2, 3, 4, 6]]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert passage in texts[2] and passage not in texts[6] and texts[3] == a
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id] += r.length
        assert 0 <= r.offset and r.offset + r.length <= 2048
    assert sorted(pieces) == [2, 3, 4, 6]


def rules_keep(text):
    """The quality rules, straight from their definitions."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    return not (len(w) < 50 or 100 * len(covered) > 50 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
                or chars < 2 * len(w) or chars > 15 * len(w) or 5 * text.count("!!") > len(w))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[k:k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_pipeline(rows):
    """{(id, text after the stages)} by comparing all documents with all."""
    docs = {(i, t or "") for i, t in rows if rules_keep(t or "")}
    rank = lambda i: (i is not None, i or 0)
    docs = {max((i for i, u in docs if u == t), key=rank): t for _, t in docs}
    prints = {i: fingerprint(t) for i, t in docs.items()}
    left, kept = set(docs), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= 4}
            left -= near
            todo += near
        kept.append(min(group, key=rank))
    cut = plain_cut([(i, docs[i]) for i in kept])
    return {i: cut[rank(i), docs[i]] for i in kept}


def test_run_equals_a_plain_version(spark, tmp_path):
    """All rows of ``run``: the pieces with their ids, and a gapless layout."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(3, 15))).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(4)]

    def text():
        parts = [" ".join(sentence() for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        return "\n".join(parts)

    texts = [text() for _ in range(60)]
    for k in range(25):
        t = rng.choice(texts).split(" ")
        t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(rng.choice(texts) for _ in range(110))]
    rows += [rows[4], rows[4], (500, "\n".join([sentence() for _ in range(900)])), (501, None), (502, ""), (503, "# " * 80), (504, "one two " * 60), (505, "a !! b " * 40)]
    # Clashing names beside the columns of documents.
    spark.createDataFrame([(i, t, None, "s", len(t or ""), "x", 1, 2) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, kept string, start int, k_id int") \
        .repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(rows)
    assert 40 < len(want) < 100
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set()
    for i, t in want.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            pieces.add((i, k // 2048, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_equal_or_null_ids_leave_one(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(400))
    near = lambda t, k: " ".join(w if n != k else "changed" for n, w in enumerate(t.split()))
    rows = [(7, text), (7, near(text, 200)), (8, near(text, 100)), (None, other), (None, near(other, 50)), (None, near(other, 300)), (9, "quite another text of its own")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, root string")
    kept = simhash.keep_one(df, shingle=4, max_bits=4).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 7, 9] and {r.root for r in kept} == {"clash"}
