import random
from collections import defaultdict

from pyspark.sql import functions as F

from career_index.llm import exact

SCHEMA = "doc_id long, text string, kept string, source int"


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    low = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[t or ""], key=low), len(groups[t or ""]), i == max(groups[t or ""], key=low)) for i, t, *_ in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def rows():
    rng = random.Random(4)
    out = [(i, rng.choice(["", None, "a", "b ", "b", "é" * 9, "x" * 70000, f"u{i}"]), "clash", i) for i in range(200)]
    return out + [(None, "a", None, None), (7, "same", "x", 1), (7, "same", "x", 1), (7, "other", "x", 1)]


def test_groups_match_brute_force(spark):
    data = rows()
    assert got(exact.exact_groups(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    data = rows()
    weak = lambda t: F.pmod(F.length(t), F.lit(3)).cast("string")
    assert got(exact.exact_groups(spark.createDataFrame(data, SCHEMA), digest=weak)) == brute(data)


def test_one_row_stays_for_each_text_with_all_columns(spark):
    data = rows()
    out = exact.deduplicate(spark.createDataFrame(data, SCHEMA))
    assert out.columns == ["doc_id", "text", "kept", "source"]
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in data})


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(empty).count() == 0
    assert exact.deduplicate(empty).count() == 0
