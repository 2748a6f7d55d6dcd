"""Products of sums that no bigint holds, against the SQL."""

import datetime

import duckdb

from foldwright.operators.queries import ORACLES, QUERIES


def test_slope_of_large_sums(spark, tmp_path):
    rows = [(i, 10**15 * (i * i % 11), "FO"[i % 2], 1.0, datetime.datetime(1995 + i % 6, 1, 1), "1") for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["u18_regslope"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(ORACLES["u18_regslope"]).fetchall()
    assert {r["g"]: (r["n"], f"{r['slope']:.9g}") for r in got} == {g: (n, f"{x:.9g}") for g, n, x in want}
