"""Repeated passages of short units, and of scripts without spaces."""

import random
import re

import pytest

from career_index.llm import substring


def cut_texts(spark, rows, **floors):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.text for r in substring.remove_repeats(df, **floors).collect()}


def prose(rng, sizes):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    return [" ".join(word() for _ in range(n)) + "." for n in sizes]


@pytest.mark.parametrize("sizes", [[3] * 20, [4, 4, 3], [12, 3, 15, 2], [1] * 9, [7, 7, 1]])
@pytest.mark.parametrize("end", [" ", "\n"])
def test_runs_of_short_units_go_whole(spark, sizes, end):
    rng = random.Random(3)
    passage = end.join(prose(rng, sizes))
    own = [prose(rng, [11])[0] for _ in range(4)]
    got = cut_texts(spark, [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]} {passage.upper()} {own[3]}")])
    assert got == {1: f"{own[0]} {passage} {own[1]}", 2: f"{own[2]} {own[3]}"}


def test_short_repeats_and_marks_without_space_stay(spark):
    rows = [(1, "Own one here. See below. Other text of it."), (2, "Another start there. See below. And more of that."),
            (3, "v.1.2.3.4.5.6.7.8 is out"), (4, "v. 1. 2. 3. 4. 5. 6. 7. 8 is out")]
    assert cut_texts(spark, rows) == dict(rows)


@pytest.mark.parametrize("passage", ["敏捷的棕色狐狸跳过了那只懒惰的狗。它再也没有回来过。", "ครั้งหนึ่งนานมาแล้วมีกระต่ายตัวหนึ่งอาศัยอยู่ในป่าใหญ่", "今日は天気がとても良いので公園を散歩しました。"])
def test_scripts_without_spaces(spark, passage):
    space = "" if passage.endswith("。") else " "
    first, second = ("第一个文档有它自己的开头。", "第二篇文章的开头完全不同。") if not space else ("ข้อความแรก", "เรื่องที่สอง")
    got = cut_texts(spark, [(1, first + space + passage), (2, second + space + passage), (3, passage), (4, "你好。")])
    assert got == {1: first + space + passage, 2: second + space, 3: "", 4: "你好。"}


def test_first_occurrence_stays_whole_when_copies_overlap_it(spark):
    rows = [(1, "\n".join(["na"] * 20)), (2, "a b c d\n" * 3)]
    assert cut_texts(spark, rows, min_line_words=4) == {1: "na\n" * 8, 2: "a b c d\n"}
    assert cut_texts(spark, rows) == {1: "na\n" * 8, 2: "a b c d\n" * 2}


def sentences(text):
    """(start, stop, words, joined, line) of each sentence with a word, for texts whose words are set off by spaces; joined: white space or a line end follows."""
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        for m in re.finditer(r"[^.!?]*[.!?]*\s*", line):
            if m[0].split():
                out.append((at + m.start(), at + m.end(), m[0].lower().split(), m.end() == len(line) or m[0][-1].isspace(), n))
        at += len(line) + 1
    return out


def all_units(text, floor):
    """(start, stop, content) by trying every run of sentences."""
    s = sentences(text)
    lines = {}
    for k, x in enumerate(s):
        lines.setdefault(x[4], []).append(k)
    ends = [sum(len(y) + 1 for y in text.split("\n")[:n + 1]) for n in range(text.count("\n") + 1)]
    first_of = {ks[0] for ks in lines.values()}
    last_of = {ks[-1] for ks in lines.values()}
    size = lambda i, j: sum(len(x[2]) for x in s[i:j + 1])
    found = set()
    for i in range(len(s)):
        for j in range(i, len(s)):
            forwards = size(i, j) >= floor and (j == i or size(i, j - 1) < floor)
            backwards = size(i, j) >= floor and (j == i or size(i + 1, j) < floor)
            whole = i in first_of and j in last_of and s[i][4] == s[j][4] and size(i, j) >= floor
            if forwards or backwards or whole:
                start = sum(len(y) + 1 for y in text.split("\n")[:s[i][4]]) if i in first_of else s[i][0]
                stop = min(ends[s[j][4]], len(text)) if i in first_of and j in last_of else s[j][1]
                content = tuple((tuple(x[2]), x[3]) for x in s[i:j]) + ((tuple(s[j][2]), None),)
                found.add((start, stop, content))
    return found


def brute(rows, floor=8):
    """Texts without the units that occur earlier: smaller id (null first), then smaller text hash rank, then smaller offset."""
    place = sorted(((i is not None, i or 0), t or "") for i, t in set(rows))
    first = {}
    for key, t in place:
        for start, stop, content in sorted(all_units(t, floor), key=lambda u: (u[0], u[1])):
            first.setdefault(content, (key, t, start, stop))
    out = {}
    for key, t in place:
        gone = [False] * len(t)
        for start, stop, content in all_units(t, floor):
            f = first[content]
            if f != (key, t, start, stop):
                low = max(start, f[3]) if f[:2] == (key, t) else start
                gone[low:stop] = [True] * max(stop - low, 0)
        out[key, t] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "Blue", "sky", "over", "low", "hill", "x1", "end"])
    pool = [" ".join(word() for _ in range(rng.randrange(1, 13))) + rng.choice([".", "!", "", "..."]) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = [rng.choice([" ", "  ", ""]).join(rng.choice(pool) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 6))]
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), rows[5], (None, rows[7][1]), (200, ""), (201, None), (202, (pool[0] + "\n") * 30 + " ".join(pool) * 40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, removed string, start int").repartition(3)
    got = substring.remove_repeats(df).collect()
    want = brute(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got) == sorted(
        (i is not None, i or 0, want[(i is not None, i or 0), t or ""]) for i, t in rows)
    assert [r.text for r in got if r.doc_id == 201] == [None] and {r.removed for r in got} == {"clash"}


def test_a_digest_with_a_third_of_all_rows_and_a_long_text(spark):
    licence = "This text is licensed to all who read it, as it is."
    rows = [(i, f"own words of number {i} and a few more besides them\n{licence}") for i in range(300)] + [(900, "\n".join([licence] * 5000))]
    got = cut_texts(spark, rows)
    assert licence in got[0] and not any(licence in t for i, t in got.items() if i)
    assert got[900] == "" and all(f"number {i} " in got[i] for i in range(300))
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
