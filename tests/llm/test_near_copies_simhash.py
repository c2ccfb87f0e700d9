"""The pipeline's near-dedup takes near fingerprints first; what they miss is found all the same."""

import numpy as np

import corpus_pipeline as pipeline
from paramloom.llm import shingles, simhash


def test_fingerprints_propose_and_shingles_decide(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for i in range(40):
        words = [f"w{rng.integers(10**6)}" for _ in range(400)]
        rows.append((10 * i, " ".join(words)))
        want.add(10 * i)
        rows.append((10 * i + 1, " ".join([*words[:-1], "other"])))  # near by any measure
        for k in (80, 160, 240, 320):
            words[k] = "changed"
        rows.append((10 * i + 2, " ".join(words)))  # similarity over 0.8, fingerprints mostly further apart
        rows.append((10 * i + 3, " ".join(words[:200])))  # a half: its own document
        want.add(10 * i + 3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    looked, confirmed = [], []
    links, verified = simhash.links, shingles._verified
    monkeypatch.setattr(simhash, "links", lambda classes, radius: looked.append(classes.count()) or links(classes, radius))
    monkeypatch.setattr(shingles, "_verified", lambda *a: confirmed.append(verified(*a)) or confirmed[-1])
    got = {r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == want
    assert looked and looked[0] <= len(rows)
    by_simhash, star = confirmed[0].count(), confirmed[1].count()
    assert by_simhash >= 40 and star > 0
