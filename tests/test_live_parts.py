"""Trials by parts equal the batch form after restarts, and run without Python."""

from pyspark.sql import functions as F

from paramloom import catalog, catalog_live
from paramloom.sources.commits import Table
from paramloom.streaming import journal as J
from paramloom.streaming import live

from .test_live import events, feed, plain, source


def test_parts_with_restarts_equal_batch(spark, tmp_path):
    df = events(spark)
    path, table = f"{tmp_path}/in", Table(spark, f"file://{tmp_path}/out")
    for k in range(3):
        feed(df.where(F.col("sequence") % 3 == k), path, 2)
        live.into_table(live.trial_parts(source(spark, path, df)), table, "trials", f"file://{tmp_path}/check").awaitTermination()
    got, want = live.trial_results(table.read(["execution_id", "trial", "metric"])), J.synthesize(df)
    columns = ["execution_id", "trial", "status", "started_at", "completed_at", F.array_sort(F.map_entries("metrics")).alias("metrics")]
    assert plain(got.where("trial is not null").select(columns)) == plain(want.where("trial is not null").select(columns))
    assert got.where("trial is null").count() == want.where("trial is null").count() > 0


def test_the_query_makes_no_python_calls_by_trial(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog_live, "_streamed", lambda journal, name, make, mode="update": made.append(make(journal)) or Stored(made[-1]))

    class Stored:
        def __init__(self, rows):
            self.rows = rows

        def read(self, keys):
            return self.rows

    found = catalog.queries()["live_trial_synthesis"](spark, "/root/testdata/sf0.001")
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString() and "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()
