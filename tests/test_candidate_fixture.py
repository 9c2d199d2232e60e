"""The candidate fixture takes every order as a job, whatever its customer."""

import duckdb

from career_index.sources.fixtures import duckdb_raw_candidates_sql, raw_candidates


def test_every_order_is_a_job(spark, tmp_path):
    keys = range(1, 13)
    spark.createDataFrame([(k, k % 25) for k in keys], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10 * k + i, k, f"{i}-HIGH") for k in keys for i in range(k % 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    want = {k: k % 3 for k in keys}
    assert {r.seq: len(r.jobs) for r in raw_candidates(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert dict(con.sql(f"SELECT seq, len(jobs) FROM {duckdb_raw_candidates_sql()}").fetchall()) == want
