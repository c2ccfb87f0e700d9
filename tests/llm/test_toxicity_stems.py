"""Counted stems, quiet lexicon words, voters of another language, repeated labelled rows."""

import random

import numpy as np

from paramloom.llm import toxicity as T


def test_levels_of_slots_are_the_same_one_by_one_and_in_arrays():
    at = np.array([0, 1, 77, T.SLOTS - 1], np.int64)
    for k in T.LEVELS:
        got = T.at_level(at, k)
        assert got.tolist() == [T.at_level(int(s), k) for s in at] and (got >= T.SLOTS).all()
    assert len({T.at_level(5, k) for k in T.LEVELS}) == len(T.LEVELS)


def test_words_of_one_prefix_are_counted_once_each():
    stem = T.slots("scheus")[4]  # the prefix of six letters
    table = {T.at_level(stem, k): k for k in T.LEVELS}
    words = T._Words(table)
    assert words.of("scheusa scheusa scheusb") == {T.at_level(stem, 2)}
    assert words.of(" ".join("scheus" + c for c in "abcde")) == set(table)
    assert T._Votes({}, frozenset(["vile"])).mask("vile") == 0 != T._Votes({}).mask("vile")


def _corpus(n=1500):
    """Two languages with toxic stems of their own; a lexicon's word is a common word of the second."""
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 9)))
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        second = rng.random() < 0.4
        words = [word("zxwvut" if second else "abcdef") for _ in range(60)]
        if second and rng.random() < 0.3:
            words.append("vile")
        if toxic:
            words += ["qrqrqr" + word("zxw") for _ in range(4)] if second else rng.sample(["idiot", "trash", "pathetic", "moron"], 3)
        elif second and rng.random() < 0.1:
            words.append("qrqrqr" + word("zxw"))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels, dict(labels)


def test_both_languages_are_caught_and_clean_documents_left_alone(spark):
    docs, labels, toxic = _corpus()
    d = spark.createDataFrame(docs + [docs[3]] * 40, "doc_id long, text string")
    model = T.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in T.score(d.where("doc_id is not null").dropDuplicates(["doc_id"]), *model, "doc_id").collect()}
    held = [i for i, _ in docs if T.zlib.crc32(str(i).encode()) % 5 == 0 and i in toxic]
    caught = [got[i] >= 0.5 for i in held if toxic[i]]
    wrong = [got[i] >= 0.5 for i in held if not toxic[i]]
    assert len(caught) > 10 and np.mean(caught) > 0.9 and np.mean(wrong) < 0.03
    again = T.fit(d.repartition(5), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert again[0] == model[0] and again[1] == model[1]
