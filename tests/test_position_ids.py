"""Position ids where the order has nulls, NaN and ties, against the query's SQL."""

import pytest

from graphloom.operators.windows import position_ids
from graphloom.plans.q_windows import ORACLES, QUERIES

SCHEMA = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"


def test_nulls_come_last_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, i, 1.0 + i, price, flag) for k in (1, None) for flag in ("A", None) for i, price in enumerate((30.0, None, 10.0, float("nan"), -5.0))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["o_w11_position_ids"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(ORACLES["o_w11_position_ids"]).fetchall()))


def test_ties_fall_to_further_columns(spark):
    rows = [(1, i, float(i % 4), 7.0, "A") for i in range(12)]
    for parts in (1, 5):
        table = spark.createDataFrame(rows[::-1], SCHEMA).repartition(parts)
        got = {r.l_linenumber: r.position_id for r in position_ids(table, "l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber").collect()}
        assert got == {i: i for i in range(12)}
