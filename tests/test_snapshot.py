"""Company snapshots as one indented JSON array and as JSON Lines."""

import json

from career_index.sources.snapshot import read_companies, read_served_companies, write_companies

ROWS = [{"name": n, "website": f"https://{n}.com", "career_page_url": c, "country_of_origin": "France", "source": "s", "jobs": []}
        for n, c in (("b", "https://b.com/jobs"), ("A", "https://a.com/jobs"), ("c", ""))]


def test_array_in_one_file(spark, tmp_path):
    path = tmp_path / "companies.json"
    path.write_text(json.dumps([*ROWS, {"name": None, "website": "https://d.com"}], indent=2))
    assert [r.name for r in read_companies(spark, str(path)).orderBy("ord").collect()] == ["b", "A", "c", None]
    assert [r.name for r in read_served_companies(spark, str(path)).collect()] == ["A", "b"]


def test_round_trip(spark, tmp_path):
    path = tmp_path / "companies.json"
    path.write_text(json.dumps(ROWS))
    out = str(tmp_path / "out")
    write_companies(read_companies(spark, str(path)), out)
    assert sorted(r.name for r in read_companies(spark, out).collect()) == ["A", "b", "c"]
    assert read_companies(spark, str(tmp_path / "none")).count() == 0
