"""External selections, bucketed tables, reachability without a closure."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paramloom.functions import domains as D
from paramloom.operators import graph
from paramloom.operators.ranking import numbered, running
from paramloom.sources import external, tables
from paramloom.sources import views as V

SF = "/root/testdata/sf0.001"
PARQUET = "paramloom.sources.external:ParquetItems"


class Letters(external.Resolver):
    """Items that are made up part by part; it takes filters on the label only."""

    def __init__(self, words: list) -> None:
        self.words = words

    def parts(self):
        return list(range(len(self.words)))

    def takes(self, column, op):
        return column == "label" and op == "equal"

    def items(self, part, filters):
        word = self.words[part]
        kept = [c for c in word if all(v == word for _, _, v in filters)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([word] * len(kept), pa.string())], names=["value", "label"])


def test_external_selections(spark):
    got = external.external(spark, PARQUET, path=f"{SF}/supplier.parquet", value="s_name", label="s_nationkey")
    assert {tuple(r) for r in got.collect()} == {(r["s_name"], str(r["s_nationkey"])) for r in V.table(spark, SF, "supplier").collect()}
    names = sorted(r["value"] for r in got.collect())
    some = external.external(spark, PARQUET, ("value", "starts_with", names[0][:3]), ("value", "in", [names[1], names[2], "x"]), ("value", "greater", names[1]), path=f"{SF}/supplier.parquet", value="s_name", label="s_name")
    assert [tuple(r) for r in some.collect()] == [(names[2], names[2])]


def test_filters_a_resolver_does_not_take_are_applied(spark):
    letters = external.external(spark, "tests.test_sources:Letters", words=["ab", "bc"])
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(letters) == [("a", "ab"), ("b", "ab"), ("b", "bc"), ("c", "bc")]
    assert rows(letters.where("label = 'bc' and value > 'b'")) == [("c", "bc")]
    some = external.external(spark, "tests.test_sources:Letters", ("label", "equal", "bc"), ("value", "greater", "b"), words=["ab", "bc"])
    assert rows(some) == [("c", "bc")] and rows(some.where("value = 'a'")) == []
    assert rows(letters.where("label = 'ab' or value = 'c'")) == [("a", "ab"), ("b", "ab"), ("c", "bc")]
    assert rows(external.external(spark, "tests.test_sources:Letters", words=[])) == []
    for bad in ("tests.test_sources:Nothing", "no.such:Thing", "tests.test_sources:SF", ""):
        with pytest.raises(LookupError):
            external.external(spark, bad)
    named = D.Resolvers()
    named.register("letters", lambda s: external.external(s, "tests.test_sources:Letters", words=["aa"]))
    assert rows(named.values(spark, "letters")) == [("a", "aa")]
    with pytest.raises(KeyError):
        named.values(spark, "numbers")


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    assert set(tables.migrate(spark, "pl_test", f"file://{tmp_path}/db", buckets=4)) == set(tables.TABLES)
    try:
        assert tables.migrate(spark, "pl_test") == []
        results, metrics = V.trial_results(spark, SF), V.trial_metrics(spark, SF)
        tables.insert(results, "pl_test", "trial_results")
        tables.insert(metrics, "pl_test", "trial_metrics")
        got = tables.join(spark.table("pl_test.trial_results"), spark.table("pl_test.trial_metrics"), "trial_id")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert got.count() == results.join(metrics, "trial_id").count() > 0
        summed = got.groupBy("trial_id").agg(F.sum("value_num"))
        assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP DATABASE pl_test CASCADE")


@pytest.mark.parametrize("seed", range(2))
def test_reachability_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(120)) if a < b})
    e = spark.createDataFrame(edges, "src string, dst string")
    after = {}
    for a, b in sorted(edges, reverse=True):
        after.setdefault(a, set()).update({b} | after.get(b, set()))
    nodes = sorted({x for p in edges for x in p})
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    got = {tuple(r) for r in graph.reaches(e, pairs).collect()}
    assert got == {(a, b) for a in after for b in after[a]}
    implied = {(a, b) for a, b in edges if any(b in after.get(c, ()) for x, c in edges if x == a)}
    assert {tuple(r) for r in graph.reduction(e).collect()} == set(edges) - implied and implied


def test_reachability_of_odd_graphs(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert graph.reduction(e).collect() == [] and graph.reaches(e, e).collect() == []
    e = spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    assert graph.reduction(e).count() == 1 and graph.reaches(e, spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "b")], e.schema)).collect() == []


def test_numbers_in_a_total_order(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 5), k, rng.randint(-3, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "a int, k int, v int").repartition(7)
    got = {r["k"]: (r["position"],) for r in numbered(df, -F.col("a"), F.col("k")).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == {r[1]: (i,) for i, r in enumerate(order)}
    got = {r["k"]: r["s"] for r in running(df, {"s": F.col("v")}, F.col("a"), F.col("k")).collect()}
    total, want = 0, {}
    for a, k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want
    assert numbered(df.where("false"), F.col("k")).collect() == []
