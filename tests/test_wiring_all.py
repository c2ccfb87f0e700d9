"""The wiring queries over all customers, counted by hand on a table that goes beyond customer 300."""

from paramloom import catalog


def test_wiring_covers_all_customers(spark, tmp_path):
    customers = [(i, ("BUILDING", "MACHINERY", "AUTOMOBILE")[i % 3], i % 5) for i in range(1, 701)]
    suppliers = [(i, i % 4) for i in range(1, 21)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    sockets = {i: {f"r:{n % 3}", "seg:BUILDING", "seg:MACHINERY" if i % 2 == 0 else "seg:NONE"} for i, n in suppliers}
    want = {(c, k) for c, seg, n in customers for k, has in sockets.items() if {f"seg:{seg}", f"r:{n % 3}"} <= has}
    got = [tuple(r) for r in catalog.wiring_match_all(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(c for c, _ in got) > 300
    classes = {r["plug"]: r["sockets"] for r in catalog.wiring_classify_all(spark, str(tmp_path)).collect()}
    assert classes == {c: sum(c == x for x, _ in want) for c, _, _ in customers}
