"""Chat formatting, BPE, quality rules, HTML extraction, SimHash and substring dedup on small tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from career_index.llm import bpe, chat, html_extract, quality, simhash, substring

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, kept string, fp int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>assistant ok", "a\\<|b", "\\", "<", "|>", "", None, "<\\|", "é🙂\n\n", "x<|", "<\\>"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(odd)] + [(None, None, None, None), (2, 0, "user", "hi"), (2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_chats(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                                       "formatted", "loss_spans")
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for i, _, r, t in rows if i == 1]
    assert got[1].loss == "".join(t or "" for i, _, r, t in rows if i == 1 and r == "assistant")
    assert [got[1].formatted[s.start:s.start + s.length] for s in got[1].loss_spans][0] == "a\\\\<\\|b"
    assert len(got[2].turns) == 2 and [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_typed_parts(spark):
    df = spark.sql(f"""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array(
        named_struct('type', 'text', 'text', 'see ', 'uri', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'image', 'text', null, 'uri', 'a.png', 'width', 28, 'height', 15, 'seconds', null, 'pages', null), null,
        named_struct('type', 'audio', 'text', null, 'uri', 'b.wav', 'width', null, 'height', null, 'seconds', 1.5D, 'pages', null),
        named_struct('type', 'document', 'text', null, 'uri', 'c.pdf', 'width', null, 'height', null, 'seconds', null, 'pages', 2)) AS array<{chat.PART}>) AS parts""")
    r = chat.format_chats(df).first()
    assert "see <|image:0|><|audio:1|><|document:2|>" in r.formatted
    assert [(a.position, a.type, a.uri, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 512)]
    assert r.n_placeholder_tokens == 554


def test_bpe_equals_tiktoken(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", None, "a  b \n c", "x" * 5000, " lead", "trail ", "it's 'S  're", "\x1c \x85 z"] + [
        "".join(rng.choice("abc XYZ é日🙂\n\t1!'") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = docs(spark, enumerate(texts))
    ids = {r.doc_id: r.ids for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    raw = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    trip = {r.doc_id: r for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert ids[k] == want and raw[k] == (t or "").encode()
        assert trip[k].n_tokens == len(want) and trip[k].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    small = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN, cache_limit=3)
    assert small.encode([t or "" for t in texts]) == [enc.encode_ordinary(t or "") for t in texts]


def test_quality_statistics(spark):
    texts = ["", None, "a b c a b c a b c", "one\ntwo\none\n \n", "x " * 60, " ".join(f"word{k}" for k in range(80)), "\x0b\x0ca\x85b\xa0c", "A!! " * 60, "#a" * 60]
    got = {r.doc_id: r for r in quality.judge(docs(spark, enumerate(texts))).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert [k for k, r in got.items() if r.kept] == [5]
    assert [r.doc_id for r in quality.keep_good(docs(spark, enumerate(texts))).collect()] == [5]
    assert quality.judge(docs(spark, [])).count() == 0


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))) for i in range(80)]
    for i in range(60):  # near copies
        own = rows[i][1].split()
        own[rng.randrange(len(own))] = "changed"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "One"), (2003, "one "), (2004, rows[3][1]), (2004, rows[3][1])]

    def brute(text):
        own = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = re.findall(r"[^\x20\x09-\x0D]+", own)
        grams = [" ".join(own[k:k + 4]) for k in range(max(1, len(own) - 3))] if own else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [brute(t) for _, t in rows]
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (i, _), a in zip(rows, fps, strict=True):
            low = min(root[j] for (j, _), b in zip(rows, fps, strict=True) if (a ^ b).bit_count() <= 4)
            changed |= low < root[i]
            root[i] = min(root[i], low)
    for cell in (1024, 2):
        got = simhash.simhash_components(docs(spark, rows), cell=cell).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", root[i]) for (i, _), f in zip(rows, fps, strict=True))
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()) == sorted(set(root.values()))
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_substring_dedup(spark):
    passage = "Here is a passage of rather many words that stands in more than one text."
    rows = [(1, f"first line of the text\n{passage}\nlast"), (2, f"Own start {passage.lower()}. Another sentence of the second text which is its own. {passage} More."),
            (3, "first  LINE of the text\nshort\nshort"), (4, None), (5, ""), (None, "first line of the text")]
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark, rows)).collect()}
    assert got[None].text == "first line of the text" and got[4].text is None and got[5].text == ""
    assert got[1].text == f"{passage}\nlast" and got[3].text == "short\nshort"
    assert passage not in got[2].text and "Another sentence" in got[2].text
    for i, t in rows:
        cut = [t[s.start:s.start + s.length] for s in got[i].removed]
        assert len(t or "") - len(got[i].text or "") == sum(map(len, cut))
    assert substring.deduplicate(docs(spark, rows)).columns == ["doc_id", "text", "kept", "fp"]
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_html_extraction(spark):
    page = ('<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>'
            "<article><h1>Head &amp; more</h1><p><b>First   words<br><p>Second &eacute; block with a <a href=x>link</a>.</p></article><footer>&copy; x</footer></body></html>")
    rows = [(k, "u", page.replace("more", f"m{k}")) for k in range(30)] + [(100, None, None), (101, "u", ""), (102, "u", "<p>cut <b"), (None, None, page)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[7].text == "Head & m7\n\nFirst words\n\nSecond é block with a link." and got[7].n_chars == len(got[7].text)
    assert got[100].text == got[101].text == ""
    assert html_extract.extract(df.limit(0)).count() == 0
