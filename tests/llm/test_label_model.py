"""The label model: moments against brute force, accuracies and correlations against a known truth, held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from paramloom.llm import toxicity


def _votes(n, rates, seed):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.3
    fires = np.stack([np.where(truth, rng.random(n) < bad, rng.random(n) < good) for bad, good in rates], 1)
    return truth, fires


def test_accuracies_correlations_and_posteriors():
    rates = [(0.7, 0.05), (0.6, 0.1), (0.5, 0.02), (0.8, 0.2), (0.4, 0.01)]
    truth, fires = _votes(40_000, rates, 1)
    fires = np.concatenate([fires, fires[:, :1]], 1)  # a voter that repeats the first
    joint = fires.T.astype(float) @ fires
    masks = (fires * (1 << np.arange(6))).sum(1).astype(np.uint64)
    model = toxicity.LabelModel(joint, len(truth), 0.3)
    true_a = [np.corrcoef(fires[:, k], truth)[0, 1] for k in range(6)]
    assert np.abs(model.accuracy[1:5] - true_a[1:5]).max() < 0.1
    assert model.correlation[0, 5] > 0.15 and model.say[0] < 0.9 < model.say[1]
    gold = np.where(np.random.default_rng(2).random(len(truth)) < 0.9, truth, ~truth)
    model.add_labels(masks, gold.astype(float))
    assert abs(model.gold_accuracy - np.corrcoef(gold, truth)[0, 1]) < 0.1
    unlabelled = model.posterior(masks, np.full(len(truth), -1))
    # a voter that doesn't fire abstains, so posteriors are high; but they put the classes in order
    ranks = np.argsort(np.argsort(unlabelled + 1e-9 * np.random.default_rng(3).random(len(truth))))
    assert (ranks[truth].mean() - ranks[~truth].mean()) / len(truth) > 0.4
    # voters can overrule a given label, and a label speaks where voters are silent
    assert model.posterior(np.array([31], np.uint64), np.array([0]))[0] > 0.5
    assert model.posterior(np.array([0], np.uint64), np.array([1]))[0] > model.posterior(np.array([0], np.uint64), np.array([-1]))[0] > model.posterior(np.array([0], np.uint64), np.array([0]))[0]


def _documents(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"w{rng.integers(300)}" for _ in range(30)]
        if i % 4 == 0:
            words[5:5] = ["you", "pathetic", "moron", "and", "worthless", "idiot", f"zork{i % 3}"]
        rows.append((i, " ".join(words), 9.0, "x"))
    return spark.createDataFrame([*rows, (None, None, None, None), (1, "again", 1.0, "x")], "doc_id long, text string, score double, toxic string")


def test_same_path_with_and_without_labels(spark):
    docs = _documents(spark)
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).distinct()
    labels = labels.unionByName(labels.limit(3).withColumn("toxic", F.lit(1)))  # contrary labels
    for given in (labels, labels.where("false")):
        bias, weights = toxicity.fit(docs, given)
        got = toxicity.score(docs, bias, weights, "doc_id").collect()
        assert len(got) == 402
        held = [r for r in got if r["doc_id"] is not None and r["doc_id"] > 3]
        assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
        assert bias == toxicity.fit(docs, given)[0]


def test_moments_equal_brute_force(spark, monkeypatch):
    docs, seen = _documents(spark), []
    first = toxicity.LabelModel.__init__
    monkeypatch.setattr(toxicity.LabelModel, "__init__", lambda self, joint, n, prior: (seen.append((joint.copy(), n)), first(self, joint, n, prior))[1])
    toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    votes = toxicity._Votes({})
    masks = [votes.mask((r["text"] or "").lower()) for r in docs.collect()]
    k = len(seen[0][0])
    want = np.array([[sum(m >> i & m >> j & 1 for m in masks) for j in range(k)] for i in range(k)])
    assert seen[0][1] == 402 and (seen[0][0] == want).all()
