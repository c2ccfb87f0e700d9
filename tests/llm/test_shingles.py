"""The near-dedup stage against brute force: exact Jaccard similarity of five-word shingles."""

import numpy as np

from paramloom.llm import simhash


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_dedup_is_exact_jaccard(spark):
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(500)]
    for base in range(40):
        text = rng.choice(words, int(rng.integers(3, 120))).tolist()
        for copy in range(4):  # similarities on both sides of 0.8
            now = list(text)
            for at in rng.integers(0, len(now), copy * int(rng.integers(1, 3))):
                now[at] = f"x{rng.integers(99)}"
            rows.append((len(rows), " ".join(now)))
    common = rng.choice(words, 30).tolist()  # a passage that many short documents share, and a chain of copies
    rows += [(1000 + i, " ".join([*common, *[f"y{i}_{k}" for k in range(i % 7)]])) for i in range(40)]
    rows += [(2000 + i, " ".join(f"z{k}" for k in range(4 * i, 4 * i + 60))) for i in range(12)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one  TWO")]
    sets = {i: _set(t) for i, t in rows}
    ids = sorted(sets)
    group = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if b < a and (sets[a] == sets[b] or (sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])))]
    for _ in range(60):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    near = [5 * len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if b < a and sets[a] & sets[b]]
    assert sum(3.5 < x < 4 for x in near) > 10 and sum(4 <= x < 4.5 for x in near) > 10
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    got = [r["doc_id"] for r in simhash.dedup(docs).collect()]
    assert got.count(None) == 1
    assert sorted(x for x in got if x is not None) == [i for i in ids if group[i] == i]
