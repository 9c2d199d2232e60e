"""The filter audit against documents removed one by one in every order."""

import random
import re
from itertools import permutations

from career_index.llm import audit

DOCS = "doc_id long, text string, source string, n int, good string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows, labels):
    """(part, set of failed filters, good, toxic) of each row, straight from the definitions."""
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = set()
        if len(w) < 50:
            bad.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows):
            bad.add("E")
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        out.append((source or "", bad, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return out


def brute(rows, labels):
    judged = fails(rows, labels)
    out = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        totals, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                totals[f] += len(gone)
                redundant = sum(f in j[1] for j in own) - len(gone)
                unique = sum(j[1] == {f} for j in own)
                lines.append(("".join(order), k + 1, f, len(left), len(gone), redundant, unique, sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out += [(part, o, k, *rest, totals[f]) for o, k, f, *rest in lines]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeA") for _ in range(rng.randrange(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 90))) + rng.choice(["", "#", " $ "]) for _ in range(25)]
    texts += ["", None, "\t \n", "Ünïcode Ωmega " * 40, "x " * 60_000, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50))]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(150)]
    rows += [rows[3], rows[3], (None, texts[0], "a"), (None, texts[0], "b"), (7, texts[1], "b"), (-5, texts[0], "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def test_every_order_equals_brute_force(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, 1, "clash", 9) for r in rows], DOCS).repartition(5)
    out = got(audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)))
    assert out == brute(rows, labels)
    assert len(out) == 600 * 4  # "a", "b", "" with the null source, and "only"


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.filter_audit(docs, labels).count() == 0
    rows = [(1, "one two", "s")]
    assert got(audit.filter_audit(spark.createDataFrame([(*r, 1, "", 1) for r in rows], DOCS), labels)) == brute(rows, [])


def test_potential_is_shapley(spark):
    """Shapley values from the recursion add up to what all filters remove, over all 120 orders."""
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, 1, "", 1) for r in rows], DOCS)
    out = audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).filter("filter_order = 'ABCDE'").groupBy("part").sum("shapley").collect()
    judged = fails(rows, labels)
    assert {r[0]: r[1] for r in out} == {p: 120 * sum(bool(j[1]) for j in judged if j[0] == p) for p in {j[0] for j in judged}}
