"""Expressions against their SQL on quantities and keys that the given tables lack: null, NaN, infinite, of both signs."""

import duckdb

import __spark_entry__ as entry


def test_div_mod_and_signed_zero_on_odd_values(spark, tmp_path):
    quantities = [25.0, 24.0, 26.0, 0.0, -0.0, None, float("nan"), float("inf"), float("-inf"), 25.000000000000004, 1e308, -1e308, 5e-324]
    rows = [(k, n, 1, 1, q, "A", 0.1) for k in (1, -1, 0, None, 9223344366, -9223344366) for n, q in enumerate(quantities)]
    names = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, l_discount double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("expr_div_mod", "expr_signed_zero"):
        want = sorted(repr(tuple(r)) for r in c.execute(entry.oracle_sql()[name]).fetchall())
        assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == want, name
