"""Near-copies among rows that share a doc_id."""

import random

from paramloom.llm import simhash


def test_different_texts_of_one_doc_id_stay(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(30))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " end", "y"), (3, c, "z"), (3, c, "z"), (0, b + " more", "w"), (None, a, "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in simhash.dedup(docs).collect()), key=str)
    assert got == sorted([(1, a, "x"), (0, b + " more", "w"), (3, c, "z"), (None, a, "n"), (None, None, "n")], key=str)
    alone = [r for r in rows if r[0] in (2, 3)][:2] + [(5, c, "q")]
    got = {r["doc_id"] for r in simhash.dedup(spark.createDataFrame(alone, docs.schema)).collect()}
    assert got == {2, 3}
