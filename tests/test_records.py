"""Metadata of records that do not exist yet, port names, checkpoints."""

from pyspark.sql import functions as F

from paramloom.operators import records

META = "scope string, id string, body string, labels map<string,string>, tags map<string,string>"


def rows(df):
    return sorted((r["scope"], r["id"], r["body"], tuple(sorted(r["labels"].items())), tuple(sorted(r["tags"].items()))) for r in df.collect())


def test_labels_and_tags_on_an_empty_store(spark):
    none = spark.createDataFrame([], META)
    change = spark.createDataFrame([("trial", "t", {"a": "1"})], "scope string, id string, entries map<string,string>")
    labelled = records.set_map(none, "labels", change)
    assert rows(labelled) == [("trial", "t", "{}", (("a", "1"),), ())]
    both = records.set_map(labelled, "tags", change.withColumn("entries", F.create_map(F.lit("z"), F.lit("2"))))
    assert rows(both) == [("trial", "t", "{}", (("a", "1"),), (("z", "2"),))]
    body = records.put_metadata(both, spark.createDataFrame([("trial", "t", "{1}"), ("trial", "u", "{2}")], "scope string, id string, body string"))
    assert rows(body) == [("trial", "t", "{1}", (("a", "1"),), (("z", "2"),)), ("trial", "u", "{2}", (), ())]
    cleared = records.set_map(body, "labels", change.withColumn("entries", F.create_map().cast("map<string,string>")))
    assert rows(cleared)[0] == ("trial", "t", "{1}", (), (("z", "2"),))


def test_repeated_changes_give_one_record(spark):
    change = spark.createDataFrame([("trial", "t", {"a": str(k)}) for k in range(9)], "scope string, id string, entries map<string,string>")
    got = [rows(records.set_map(spark.createDataFrame([], META), "labels", change.repartition(n))) for n in (1, 4)]
    assert len(got[0]) == 1 and got[0] == got[1]


def test_ports_and_result_parameters_are_unique(spark):
    e = [("plug and socket", ["in", "in"], ["r"]), ("apart", ["in", "out"], ["r", "q"]), ("results", ["in"], ["r", "r"]), ("no results", [], None)]
    df = spark.createDataFrame(e, "element string, ports array<string>, result_parameters array<string>")
    df = df.select("*", F.create_map(F.lit("type"), F.lit("t")).alias("labels"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"), F.array(F.lit("x")).alias("parameters"), F.array(F.lit("x")).alias("config_keys"), F.lit(None).cast("int").alias("max_concurrency"), F.lit(None).cast("int").alias("max_group_concurrency"))
    types = spark.createDataFrame([("t", [], [])], "type string, required array<string>, forbidden array<string>")
    got = {r["element"]: r["violations"] for r in records.element_violations(df, types).collect()}
    assert got == {"plug and socket": ["repeated port"], "apart": [], "results": ["repeated result parameter"], "no results": []}
