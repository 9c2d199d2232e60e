import random
import re

import pytest

from career_index.llm import lines

SCHEMA = "doc_id long, text string, line string, kept int"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a == b or a[k + 1:] == b[k + 1:] or a[k + 1:] == b[k:] or a[k:] == b[k + 1:]


def brute(rows, edits):
    norm = lambda x: re.sub(r"[ \t\n\r\f\x0b]+", " ", x.lower()).strip(" ")
    places = sorted(((i is not None, i or 0, k), norm(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")) if norm(x))
    out = []
    for p, s in places:
        match = next(q for q, t in places if t == s or edits and within_one(t, s) and q < p)
        out.append((p, match == p, match))
    return sorted(out)


def got(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.line), r.kept, (r.match_doc_id is not None, r.match_doc_id or 0, r.match_line)) for r in df.collect())


def fixture():
    rng = random.Random(11)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 14))) for _ in range(40)]

    def edited(s):
        k = rng.randrange(len(s) + 1)
        return rng.choice([s[:k] + rng.choice("abz") + s[k:], s[:k] + s[k + 1:], s[:k] + "q" + s[k + 1:], s, s.upper() + "  "])

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(6)))) for i in range(60)]
    long = "x" * 3000 + " middle " + "y" * 3000
    return rows + [(None, base[0]), (100, None), (101, ""), (102, long), (103, long.replace("middle", "midle")), (104, long[:-1]), (105, "\n\n" + long + "\n")]


@pytest.mark.parametrize("edits", [0, 1])
def test_verdicts_match_brute_force(spark, edits):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    assert got(lines.line_verdicts(df, max_edits=edits)) == brute(rows, edits)


def test_short_lines_next_to_each_other(spark):
    rows = [(k, t) for k, t in enumerate(["a", "b", "ab", "abc", "cba", "", "aa", "aab", "xaab", "aabx"])]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert got(lines.line_verdicts(df)) == brute(rows, 1)


def test_text_without_removed_lines(spark):
    df = spark.createDataFrame([(1, "one line here\nanother", "c", 1), (2, "One  line hera\nthird\n\nanother", "c", 1), (3, None, "c", 1)], SCHEMA)
    out = {r.doc_id: r.text for r in lines.deduplicate(df).collect()}
    assert out == {1: "one line here\nanother", 2: "third\n", 3: None}


def test_empty_table_and_bound(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.line_verdicts(empty).count() == 0
    with pytest.raises(ValueError, match="max_edits"):
        lines.line_verdicts(empty, max_edits=2)
