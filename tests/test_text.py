"""Text functions against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from career_index.functions.text import collapse_ws, fold, ustrip
from career_index.operators.extract import decode_entities


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i long, x string")
    return [r.y for r in df.select("i", expr("x").alias("y")).orderBy("i").collect()]


def test_fold_equals_casefold_on_all_code_points(spark):
    points = [chr(k) for k in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    text = ["".join(points[k:k + 997]) for k in range(0, len(points), 997)] + ["", None, "ΑΣ ΑΣΑ İIı ﬁn Straße"]
    assert column(spark, text, fold) == [x and x.casefold() for x in text]


def test_references_equal_the_standard_library(spark):
    rng = random.Random(8)
    names = sorted(html5)
    texts = [f"&{n}" for n in names] + [f"a &{n} y&{n.rstrip(';')}z" for n in names]
    texts += [f"&#{k};" for k in [0, 1, 8, 9, 10, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 55296, 64976, 65534, 65535, 131071, 1114111, 1114112, 10**12]]
    texts += ["&#x41;", "&#X0000000000041", "&#65 b", "&#x;", "&#;", "&;", "& &amp &&lt;", "&copy y", "&check;", "&notit;", "&notin;", "&" + "a" * 40 + ";", "&ampamp;", "&#xZ"]
    texts += ["".join(rng.choice(["&", "#", "x", "amp", "lt;", "not", "in;", "é", " ", "8217;", ";"]) for _ in range(12)) for _ in range(400)]
    got = column(spark, texts, decode_entities)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != html.unescape(t)] == []


def test_white_space_equals_the_standard_library(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x1c\x1f\x85\xa0 　 ") for _ in range(rng.randrange(9))) for _ in range(500)] + [" ", " x ", "\x1cé\x1f"]
    assert column(spark, texts, ustrip) == [t.strip() for t in texts]
    assert column(spark, texts, collapse_ws) == [" ".join(_runs(t)) for t in texts]


def _runs(text):
    import re
    return re.split(r"\s+", text)
