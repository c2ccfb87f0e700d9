"""Each stage of the pipeline against a plain version, on nulls, empty texts, repeated rows and clashing values."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from paramloom.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = "you are a worthless idiot and a pathetic moron"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    words, out = [f"w{i}" for i in range(300)], []
    for i in range(80):
        lines = [" ".join(rng.choice(words, 14)) for _ in range(3)]
        if i % 4 == 0:
            lines.append(BAD)
        if i % 5 == 1:
            lines.insert(1, "a line that many of the documents have in common")
        out.append([i, "\n".join(lines), "en", f"s{i % 3}", 0])
    for i in range(10):  # near copies: one word of 42 and more differs; exact copies
        out.append([100 + i, out[4 * i + 3][1].rsplit(" ", 1)[0] + f" x{i}", "en", "s0", 0])
        out.append([200 + i, out[4 * i + 2][1], None, None, 0])
    out += [[300, None, None, None, None], [301, "", "en", "s1", 0], [302, " \n\t", "en", "s1", 0], [303, "short text", "en", "s2", 0]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def _rows(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def test_toxicity(spark, docs, rows, tmp_path):
    labels = docs.select("doc_id", F.coalesce(F.col("text").contains(BAD), F.lit(False)).cast("int").alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.drop_toxic(spark, docs.unionByName(docs.where("doc_id = 7")), str(tmp_path))
    assert got.columns == pipeline.COLUMNS
    want = Counter(r for r in rows if BAD not in (r[1] or ""))
    want[next(r for r in rows if r[0] == 7)] += 1
    assert Counter(_rows(got)) == want
    assert pipeline.drop_toxic(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_lines(spark, docs, rows):
    seen, want = [], []
    for i, text, lang, source, _ in sorted(rows):
        keep = []
        for line in (text or "").split("\n"):
            s = frozenset(line.lower().split())
            if not (s and any(5 * len(s & t) >= 4 * len(s | t) for t in seen)):
                keep.append(line)
            if s:
                seen.append(s)
        now = None if text is None else "\n".join(keep)
        want.append((i, now, lang, source, None if now is None else len(now)))
    assert Counter(_rows(pipeline.drop_lines(spark, docs, ""))) == Counter(want)
    assert pipeline.drop_lines(spark, docs.where("false"), "").count() == 0


def test_near_copies(spark, docs, rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r[0]: shingles(r[1]) for r in rows}
    group = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if b < a and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    for _ in range(20):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = _rows(pipeline.drop_near_copies(spark, docs, ""))
    assert len(links) >= 20 and Counter(got) == Counter(r for r in rows if group[r[0]] == r[0])
    assert pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_mix(spark, docs, rows):
    again = docs.unionByName(docs.where("doc_id in (5, 6)")).unionByName(docs.where("doc_id = 6"))
    copies = Counter()
    for r in mixing.mix(again).collect():
        copies[r["doc_id"]] += r["copies"]
    got = _rows(pipeline.mix_sources(spark, again, ""))
    assert Counter(r[0] for r in got) == +copies and set(got) <= set(rows)
    assert pipeline.mix_sources(spark, docs.where("false"), "").count() == 0


def test_packing(spark, docs, rows):
    library = Tokenizer.from_file(packing.default_vocabulary())
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    pieces = pipeline.pack_sequences(spark, docs, "").collect()
    runs = {}
    for p in pieces:
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["offset"] + p["length"] <= 4096
        runs.setdefault(p["doc_id"], []).extend(range(p["start"], p["start"] + p["length"]))
    assert {i: sorted(x) for i, x in runs.items()} == {i: list(range(len(x))) for i, x in ids.items()}
    assert pipeline.pack_sequences(spark, docs.where("false"), "").count() == 0
