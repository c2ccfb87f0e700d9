"""Curated goldens and negative cases of the engine's own operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paramloom.functions import constraints as C
from paramloom.functions import domains as D
from paramloom.functions.expressions import Call, ExpressionError, If, Ref, check, compile_expr, lift
from paramloom.operators import graph, retention, scheduling, wiring
from paramloom.operators.aggregates import Aggregation, aggregate
from paramloom.operators.filters import apply_filter, where
from paramloom.plans import grid, lifecycle
from paramloom.sources.store import ConflictError, Store
from paramloom.streaming import journal as J

BASE = 1_700_000_000
ROWS = [(1, "completed", 10, 1), (2, "completed", 20, 1), (3, "completed", 30, 2), (4, "completed", 40, 1), (5, "failed", 500, 3), (6, "skipped", 999, 1)]
LATENCY = ("db", "latency_ms")


@pytest.fixture(scope="module")
def curated(spark):
    at = lambda n: dt.datetime.fromtimestamp(BASE + n, dt.UTC).replace(tzinfo=None)
    results = spark.createDataFrame([(n, s, a, at(n), f"0x{n}0") for n, s, _, a in ROWS], "trial_id long, status string, attempt int, started_at timestamp, code string")
    metrics = spark.createDataFrame([(n, *LATENCY, float(v), None, None) for n, _, v, _ in ROWS], "trial_id long, element string, parameter string, value_num double, value_text string, value_bool boolean")
    return results, metrics, at


def test_filter_goldens(curated):
    r, m, at = curated
    count = lambda f: apply_filter(r, f, m, None).count()
    assert count(where("any")) == 6
    assert count(where("status", "completed")) == 4
    assert count(where("status_in", ("failed", "skipped"))) == 2
    assert count(where("started_after", at(3))) == 3
    assert [count(where("attempt", c, v)) for c, v in (("eq", 1), ("ne", 1), ("lt", 2), ("le", 2), ("gt", 1), ("ge", 1))] == [4, 2, 4, 5, 2, 6]
    assert [count(where("metric", *LATENCY, c, v)) for c, v in (("lt", 50), ("ge", 100), ("eq", 500))] == [4, 2, 1]
    assert count(~where("metric", "db", "missing", "lt", 50)) == 6
    assert count(where("metric", *LATENCY, "lt", 15) | where("status", "failed")) == 2
    assert count(~(where("metric", *LATENCY, "lt", 15) | where("status", "failed"))) == 4


def test_aggregate_goldens(curated):
    r, m, _ = curated
    value = lambda a, rows=r: aggregate(rows, a, m).first()["value"]
    assert [value(Aggregation(o, LATENCY)) for o in ("min", "max", "sum")] == [10, 999, 1599]
    assert value(Aggregation("avg", LATENCY), apply_filter(r, where("status", "completed"))) == 25
    assert value(Aggregation("percentile", LATENCY, 0.5)) == 30
    groups = aggregate(r, Aggregation("count", by=("status",))).collect()
    assert len(groups) == 3 and sum(g["value"] for g in groups) == 6
    assert value(Aggregation("max", LATENCY), r.where("false")) is None
    with pytest.raises(Exception, match="no values"):
        aggregate(r.where("false"), Aggregation("max", LATENCY), m, strict=True).collect()


def test_expressions(spark):
    schema = {"i": "integer", "x": "double", "s": "string"}
    row = spark.createDataFrame([((1 << 63) - 1, 2.5, "é")], "i long, x double, s string")
    get = lambda e: row.select(compile_expr(e, schema)).first()[0]
    i, x = Ref("i"), Ref("x")
    assert get(i + 1) == -(1 << 63) and get(i * i) == 1 and get(-(i + 1)) == -(1 << 63)
    assert get(Call("round", (x,))) == 2 and get(Call("round", (x + 1.0,))) == 4 and get(Call("ceil", (x,))) == 3 and get(Call("floor", (-x,))) == -3
    assert get(Call("round", (x * 1e300,))) == (1 << 63) - 1 and get(Call("round", (lift(0.0) / lift(0.0),))) == 0
    assert get(x / lift(0.0)) == float("inf") and get(Call("len", (Ref("s"),))) == 2
    assert get(lift(-7) % lift(3)) == -1 and get(lift(-7) / lift(2)) == -3
    assert get(Call("max", (lift(0.0) / lift(0.0), x))) == 2.5 and get(If(x > 2.0, i, lift(0))) == (1 << 63) - 1
    for bad in (i + x, Ref("nope"), Call("round", (i,)), If(i, i, i), x % 2.0):
        with pytest.raises(ExpressionError):
            check(bad, schema)
    with pytest.raises(Exception, match="division by zero"):
        get(i / lift(0))


def test_constraints(spark):
    a, b = C.leaf("integer", "min", 3), C.leaf("integer", "max", 9)
    assert C.fingerprint(a & b) == C.fingerprint(b & a & a) != C.fingerprint(a | b)
    assert C.canonical(~~a) == a and C.canonical(a & C.Constraint("integer", "always")) == a
    assert C.canonical(a & C.Constraint("integer", "never")).op == "never"
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    no = C.compile_constraint(~C.leaf("double", "min", 5.0), F.col("x"))
    assert [r[0] for r in rows.select(no).collect()] == [True, False, False]


def test_domains(spark):
    d = D.Domain("integer", 1, 10)
    assert d.cardinality() == 10 and d.boundaries() == [1, 10] and d.enumerate(spark).count() == 10
    assert D.Domain("integer", 5, 5).boundaries() == [5] and D.Domain("boolean").cardinality() == 2
    assert D.satisfiable(d, C.leaf("integer", "min", 10), spark) and not D.satisfiable(d, C.leaf("integer", "min", 11), spark)
    with pytest.raises(D.NotEnumerable):
        D.Domain("double", 0.0, 1.0).enumerate(spark)


def test_grid(spark):
    axes = [grid.Axis("e", "a", (1, 2, 3)), grid.Axis("e", "b", (1, 2)), grid.Axis("e", "c", (1, 2, 3, 4))]
    g = grid.enumerate_grid(spark, axes)
    assert g.count() == 24 and g.select("code").distinct().count() == 24
    assert g.where("trial = 10").first()["code"] == "0x102"
    assert grid.enumerate_grid(spark, []).count() == 1
    assert grid.validate([grid.Axis("e", "a", (1, 1)), grid.Axis("e", "a", ())])
    assert grid.width([17]) == 2 and grid.width([16]) == 1 and grid.width([5000]) == 4
    with pytest.raises(ValueError):
        grid.sample(spark, 5, "random", 0)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert graph.closure(e).count() == 5
    assert {tuple(r) for r in graph.reduction(e).collect()} == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}
    assert graph.critical_path(n, e) == ["a", "c", "d"]
    with pytest.raises(ValueError, match="cycle"):
        graph.depths(n, e.union(spark.createDataFrame([("d", "a")], e.schema)))


def test_plan_is_valid(spark):
    elements = spark.createDataFrame([("svc", 0, True), ("job", 1, False)], "element string, level int, health boolean")
    links = spark.createDataFrame([("job", "svc", "shared")], "src string, dst string, kind string")
    s, e = lifecycle.compile_plan(spark.range(3).withColumnRenamed("id", "trial"), elements, links, [3])
    depth = {r["node"]: r["depth"] for r in graph.depths(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), e).collect()}
    assert s.count() == 8 and depth["plan:start"] == 0 and depth["plan:end"] == max(depth.values())
    for t in range(3):
        assert depth["ready:svc:0"] < depth[f"deploy:job:{t}"] < depth[f"start:{t}"] < depth[f"end:{t}"] < depth[f"teardown:job:{t}"] < depth["teardown:svc:0"]


def test_retention_equals_greedy(spark):
    rows = [(c, i, (i * 37) % 50) for c in "xy" for i in range(30)]
    got = {(r["c"], r["i"]) for r in retention.keep_size(spark.createDataFrame(rows, "c string, i int, s long"), ["c"], "i", "i", "s", 300).collect()}
    want = set()
    for c in "xy":
        held = [r for r in rows if r[0] == c]
        while sum(r[2] for r in held) > 300:
            held.pop(0)
        want |= {(r[0], r[1]) for r in held}
    assert got == want


def test_wiring_and_scheduling(spark):
    p = spark.createDataFrame([("p1", ["a:1"]), ("p2", ["a:1", "b:2"]), ("p3", ["z:9"])], "plug string, facets array<string>")
    k = spark.createDataFrame([("s1", ["a:1"]), ("s2", ["a:1", "b:2"])], "socket string, facets array<string>")
    c = wiring.classify(p, k)
    assert {r["plug"]: r["match"] for r in c.collect()} == {"p1": "many", "p2": "one", "p3": "none"}
    assert wiring.overall(c).first()[0] == "partial"
    q = spark.createDataFrame([("q", f"s{i}", 1, x, 1.0) for i, x in enumerate([3.0, 5.0, 1.0, 4.0])], "queue string, step string, turn int, cpu double, memory double").drop("turn")
    got = scheduling.admit(q.withColumn("trial", F.lit(1)).withColumn("turn", F.substring("step", 2, 1).cast("int")), 8.5, 99.0)
    assert [r["admitted"] for r in got.orderBy("turn").collect()] == [True, True, False, False]


def test_store(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/store")
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, body string")
    st.save_once("plans", ["id"], df((1, "a"), (2, "b")), "body")
    st.save_once("plans", ["id"], df((1, "a")), "body")
    with pytest.raises(ConflictError):
        st.save_once("plans", ["id"], df((1, "other")), "body")
    st.upsert("plans", df((2, "new")))
    st.delete("plans", df((1, "a")))
    assert [tuple(r) for r in st.read("plans", ["id"]).collect()] == [(2, "new")]


def test_streamed_recovery_equals_batch(spark, tmp_path):
    rows = [(1, 1, "step_started", "a"), (1, 2, "step_failed", "a"), (1, 3, "step_started", "a"), (1, 4, "step_completed", "a"), (1, 5, "step_started", "b"), (2, 1, "step_skipped", "c")]
    df = spark.createDataFrame(rows, "execution_id long, sequence int, kind string, step_id string")
    for i in (0, 3):
        df.where(f"sequence > {i} and sequence <= {i + 3}").write.mode("append").parquet(f"{tmp_path}/j")
    q = J.stream_recovery(J.tail(spark, f"{tmp_path}/j", df.schema), "recovered").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("recovered").collect()} == {tuple(r) for r in J.recovery(df).collect()}
    assert {r["step_id"] for r in J.recovery(df).where("in_flight").collect()} == {"b"}


def test_journal_synthesis_rules(spark):
    e = spark.createDataFrame([(1, "t", 1, "trial_start", 1, None, None), (1, "t", 2, "save", 2, "m", 1.0), (1, "t", 3, "save", 3, "m", 2.0), (1, "t", 4, "trial_end", 4, None, None), (1, "u", 5, "trial_start", 5, None, None), (1, "v", 6, "step_failed", 6, None, None), (1, "v", 7, "trial_end", 7, None, None)], "execution_id long, trial string, sequence int, kind string, ts long, metric string, value double")
    got = {r["trial"]: r for r in J.synthesize(e).collect()}
    assert set(got) == {"t", "v"} and got["t"]["metrics"] == {"m": 2.0} and got["t"]["status"] == "completed" and got["v"]["status"] == "failed"
