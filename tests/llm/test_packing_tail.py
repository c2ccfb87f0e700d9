"""Many small sources: each comes in proportion, and every token is packed once."""

import numpy as np

from paramloom.llm import packing


def test_small_sources_keep_their_share(spark):
    rows = []
    for s in range(200):  # 0.5 % each; some in one long document, some in many short ones
        for k in range(1 if s % 2 else 10):
            rows.append((len(rows), f"s{s}" if s else None, "word " * (5999 if s % 2 else 599)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces = packing.pack(docs).collect()
    at = np.array([r["sequence_id"] * 4096 + r["offset"] for r in pieces])
    size = np.array([r["length"] for r in pieces])
    order = np.argsort(at)
    assert (at[order][1:] == (at + size)[order][:-1]).all() and at.min() == 0
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert len(by_doc) == len(rows)
    for runs in by_doc.values():
        runs.sort()
        assert [s for s, _, _ in runs] == np.cumsum([0, *[n for _, n, _ in runs]])[:-1].tolist() and sum(n for _, n, _ in runs) == runs[0][2]
    total = int(size.sum())
    for source in {r["source"] for r in pieces}:
        mine = np.array([r["source"] == source for r in pieces])
        all_ = int(size[mine].sum())
        for end in range(0, total, 40 * 4096):
            given = int(np.clip(end - at[mine], 0, size[mine]).sum())
            assert abs(given - all_ * end / total) <= 2 * packing.LEAST_QUOTA + 1
