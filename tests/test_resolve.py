"""W8 / W2 against small sequential models written from the specification."""

import random

import pytest
from pyspark.sql import functions as F

from career_index.operators.dedupe import greedy_dedupe
from career_index.operators.contraction import components
from career_index.operators.resolve import final_records, live_keys, resolve_domain_only, resolve_fold
from career_index.functions.text import name_key
from career_index.functions.urls import normalize_url


def model_w8(records):
    """{order of the record that holds a place: order of the record that opened it}, for records in global order."""
    points, place = {}, {}  # key -> index of a record; index -> order of the opener of its place

    def tags(r):
        host = r["website"].partition("://")[2].partition("/")[0].lower().removeprefix("www.")
        return ([("domain", host)] if host else []) + [("name", " ".join(r["name"].lower().split()))]

    def facts(r):
        known = r["country_of_origin"] != "Unknown"
        return known + (r["source"] != "unknown") + bool(r["jobs"]), known, -len(r["career_page_url"])

    for k, r in enumerate(records):
        at = next((points[t] for t in tags(r) if t in points), None)
        if at is not None and not any(new > old for new, old in zip(facts(r), facts(records[at]), strict=True)):
            continue
        if at is None:
            place[k] = r["ord"]
        elif at in place:
            place[k] = place.pop(at)
        points.update(dict.fromkeys(tags(r), k))
    return {records[k]["ord"]: opener for k, opener in place.items()}


def random_records(rng, n):
    out = []
    for i in range(n):
        out.append({
            "ord": i * 7 + rng.randint(0, 6),
            "name": rng.choice(["Acme", "ACME ", "Beta", "beta  co", "Gamma", "Delta", "acme"]),
            "website": "https://" + rng.choice(["www.a.com", "a.com", "b.com", "c.com", "d.org", "www.", "e.net"]),
            "career_page_url": "https://x.com/" + "c" * rng.randint(1, 4),
            "country_of_origin": rng.choice(["Unknown", "France", "Spain"]),
            "source": rng.choice(["wikipedia", "unknown", "clutch"]),
            "jobs": [] if rng.random() < 0.5 else [{"title": "Dev", "url": "https://j.com/1"}],
        })
    out.sort(key=lambda r: r["ord"])
    return out


SCHEMA = ("ord long, name string, website string, career_page_url string, country_of_origin string, "
          "source string, jobs array<struct<title:string,url:string>>")


def trials(rng, count):
    """Random record lists with keys of their own, as one list in one order; and each list by itself."""
    lists = []
    for t in range(count):
        recs = random_records(rng, rng.randint(1, 45))
        names = rng.randint(1, 25)
        for r in recs:
            if rng.random() < 0.5:  # names of one domain, of several, and domains of one record
                r["name"] = f"name {rng.randint(1, names)}"
            if rng.random() < 0.2:
                r["website"] = f"https://once{r['ord']}.com"
            if rng.random() < 0.1:
                r["website"] = "https://www./x."
            r["name"] = f"{r['name']} t{t}"
            host, sep, path = r["website"].partition("://")[2].partition("/")
            r["website"] = "https://" + (host if host == "www." else f"{host.removesuffix('.com')}.t{t}.com") + sep + path
            r["ord"] = r["ord"] * count + t
        lists.append([r for r in recs if "." in r["website"].partition("://")[2].partition("/")[0]])
    return lists, sorted((r for x in lists for r in x), key=lambda r: r["ord"])


def places(df):
    return {r["ord_rec"]: r["ord"] for r in df.select("ord_rec", "ord").collect()}


@pytest.mark.parametrize("segment_bits,fan_bits", [(12, 6), (1, 1)])
def test_w8_matches_sequential_model(spark, segment_bits, fan_bits):
    """200 random lists side by side; ``www.`` alone gives an empty domain key, so those records go by name across lists' domains."""
    rng = random.Random(7 + segment_bits)
    lists, recs = trials(rng, 200)
    fin = final_records(spark.createDataFrame([tuple(r.values()) for r in recs], SCHEMA).repartition(5)).withColumn("ord_rec", F.col("ord"))
    want = {k: v for x in lists for k, v in model_w8(x).items()}
    assert places(resolve_fold(fin, segment_bits=segment_bits, fan_bits=fan_bits)) == want


def model_domain_only(records):
    out, holder = {}, {}
    for r in records:
        host = r["website"].partition("://")[2].partition("/")[0].lower().removeprefix("www.")
        if not host:
            out[r["ord"]] = r["ord"]
            continue
        known = r["country_of_origin"] != "Unknown"
        facts = (known + (r["source"] != "unknown") + bool(r["jobs"]), known, -len(r["career_page_url"]))
        if host not in holder:
            holder[host] = (facts, r["ord"], r["ord"])
        elif any(a > b for a, b in zip(facts, holder[host][0], strict=True)):
            holder[host] = (facts, r["ord"], holder[host][2])
    return out | {rec: slot for _, rec, slot in holder.values()}


@pytest.mark.parametrize("segment_bits,fan_bits", [(12, 6), (2, 1), (0, 2)])
def test_w8_domain_only_composes_segments(spark, segment_bits, fan_bits):
    """A domain with most of the records, cut into segments of 4 records or of one."""
    rng = random.Random(3)
    _, recs = trials(rng, 12)
    for r in recs:
        if rng.random() < 0.6:
            r["website"] = "https://www.hub.com"
            r["career_page_url"] = "https://x.com/" + "c" * rng.randint(1, 60)
    fin = final_records(spark.createDataFrame([tuple(r.values()) for r in recs], SCHEMA).repartition(4)).withColumn("ord_rec", F.col("ord"))
    assert places(resolve_domain_only(fin, segment_bits, fan_bits)) == model_domain_only(recs)


def test_w8_hub_domain_with_names_of_its_own_needs_no_python_worker(spark):
    """Names bound to one domain are never live keys, so the hub is folded by segments alone."""
    rows = [(i, f"n{i % 50}", "https://hub.com", f"https://x.com/{'c' * (i % 7)}", "France", "s", None) for i in range(300)]
    fin = final_records(spark.createDataFrame(rows, SCHEMA))
    keys = fin.selectExpr("ord", "'hub.com' AS dk", "name AS nk", "7 AS score", "false AS unk", "1 AS clen")
    assert live_keys(keys).filter("n IS NOT NULL").isEmpty()
    folded = resolve_fold(fin, segment_bits=3)
    assert "Python" not in folded._jdf.queryExecution().toString()
    assert [r.ord for r in folded.collect()] == [0]


def test_chain_of_records_contracts_in_few_rounds(spark):
    n = 10_000
    out = components(spark.range(n).selectExpr("id AS u", "id + 1 AS v"))
    assert out.rounds <= 20
    assert out.count() == n + 1 and out.select("root").distinct().count() == 1


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7)] + [(1000, k) for k in range(1001, 1200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == {x for u, v in edges if u != v for x in (u, v)}
    groups = lambda f: sorted(sorted(x for x in got if f(x) == g) for g in {f(x) for x in got})
    assert groups(got.get) == groups(find)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def model_w2(rows):
    kept = []
    for row in rows:
        if all(row[1] != k[1] and (not row[2] or row[2] != k[2]) for k in kept):
            kept.append(row)
    return [o for o, _, _ in kept]


def test_w2_matches_sequential_model(spark):
    rng = random.Random(11)
    for trial in range(5):
        rows = [(i, rng.choice(["a", "b", "c", "d", "e", "f"]), rng.choice(["", "w1", "w2", "w3", "w4"]))
                for i in range(rng.randint(3, 30))]
        df = spark.createDataFrame(rows, "o long, name string, website string")
        got = sorted(r.o for r in greedy_dedupe(df, name_key("name"), normalize_url("website"), ["o"]).collect())
        assert got == model_w2(rows), f"trial {trial}"


def test_w2_third_row_kept(spark):
    df = spark.createDataFrame([(1, "n1", "w1"), (2, "n1", "w2"), (3, "n3", "w2")], "o long, name string, website string")
    got = sorted(r.o for r in greedy_dedupe(df, name_key("name"), normalize_url("website"), ["o"]).collect())
    assert got == [1, 3]


def dense_rows(rng, n, keys):
    return [(i, f"n{rng.randrange(keys)}", rng.choice(["", *[f"w{k}" for k in range(keys)]])) for i in range(n)]


def test_w2_many_lists_side_by_side(spark):
    """120 random lists with keys of their own in one run."""
    rng = random.Random(23)
    lists = [[(i * 120 + t, f"{a} l{t}", b and f"{b}-l{t}") for i, a, b in dense_rows(rng, rng.randint(1, 60), rng.randint(1, 25))] for t in range(120)]
    df = spark.createDataFrame([r for x in lists for r in x], "o long, name string, website string").repartition(6)
    got = sorted(r.o for r in greedy_dedupe(df, F.col("name"), F.col("website"), ["o"]).collect())
    assert got == sorted(o for x in lists for o in model_w2(x))


@pytest.mark.parametrize("n,rounds", [(24, 6), (100_000, 6)])
def test_w2_chain_takes_few_rounds(spark, n, rounds):
    """Every row shares a key with the one before and the other with the one after: each second row stays."""
    df = spark.range(n).selectExpr("id AS o", "concat('n', (id + 1) div 2) AS name", "concat('w', id div 2) AS website")
    got = greedy_dedupe(df, F.col("name"), F.col("website"), ["o"], max_rounds=rounds)
    assert got.selectExpr("count(*)", "sum(o % 2)").first()[:] == (n // 2, 0)


def test_w2_raises_instead_of_returning_short(spark):
    rows = dense_rows(random.Random(1), 400, 60)
    df = spark.createDataFrame(rows, "o long, name string, website string")
    with pytest.raises(RuntimeError, match="undecided"):
        greedy_dedupe(df, F.col("name"), F.col("website"), ["o"], max_rounds=1)
    got = sorted(r.o for r in greedy_dedupe(df, F.col("name"), F.col("website"), ["o"]).collect())
    assert got == model_w2(rows)


def test_w2_keeps_a_row_with_a_null_key(spark):
    df = spark.createDataFrame([(1, None, "w1"), (2, "n", "w2")], "o long, name string, website string")
    assert sorted(r.o for r in greedy_dedupe(df, F.col("name"), F.col("website"), ["o"]).collect()) == [1, 2]
