"""Payloads are made once an event."""

import __spark_entry__ as entry


def test_no_filter_makes_payloads_anew(spark):
    df = entry.queries()["journal_payload_problems"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("json" in line.lower() for line in filters)
