"""Rules filed under tokens of the path, more rules than a plan constant holds, empty tables, clashing names."""

from pyspark.sql import functions as F

from paramloom.llm import urlrules
from paramloom.llm.urlrules import Rule

RULES = (*urlrules.STATED, *urlrules.PATTERNS, Rule.free("block", "login page", r"\n[^\n]*/login(?:/|$)", "login"), Rule.free("allow", "about page", r"\n/about", "about"))


def test_path_tokens_and_join(spark, monkeypatch):
    urls = [None, "", "none", "http://a.example.net/en/x", "https://A.Example.NET/login", "ftp://b.org/fr/", "x://casino.example.com/de/login", "http://q.com/about", "http://q.com/a/login?x=1", "http://q.com/a/login?x=1", "http://q.com/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, best long")
    show = lambda df: sorted((r["page_id"], r["host"], r["path"], r["best"] and tuple(r["best"])[2:]) for r in df.collect())
    one = show(urlrules.judge(pages, RULES))
    names = {i: b and b[0] for i, _, _, b in one}
    assert names == {0: None, 1: None, 2: None, 3: "example.net/en/", 4: "net/", 5: "org/fr/", 6: "example.com/de/", 7: "about page", 8: "login page", 9: "login page", 10: None}
    monkeypatch.setattr(urlrules, "MAX_RULES", 2)
    assert show(urlrules.judge(pages, RULES)) == one
    assert urlrules.judge(pages.where(F.lit(False)), RULES).count() == 0
    monkeypatch.undo()
    assert urlrules.judge(pages.where(F.lit(False)), RULES).count() == 0
