"""Alignment of tokens against a plain loop over all token pairs of a text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paramloom.llm import alignment

PATHS = alignment.default_paths()


def texts():
    rng = random.Random(11)
    words = ["the", "alignment", "of", "tokenizers,", "naïve", "Straße", "日本語", "x=1;", "▁", "​", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x41>", "don't", "  ", "\n", "\t", "\r\n", "\x00", "ﬁ", "1234567", "ARCHITECTURE", "́"]
    out = [None, "", " ", "  a", "a ", "\n\n\n", "▁", "a▁b", "<|endoftext|>", "<s></s><unk>", "é" * 50, "a" * 3000, " x"]
    out += [rng.choice(["", " "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    out += ["The quick brown fox. " * k for k in (1, 2, 3, 400)]
    return out


def plain(rows):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = dict(zip([chr(c) for c in own], own)) | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in own)}
    out, counts = [], Counter()
    for t in rows:
        p, q = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        pb = [bytes(code[c] for c in a.id_to_token(k)) for k in p]
        qb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in q]
        if not t or b"".join(pb) != b" " + t.encode() or b"".join(qb) != b" " + t.encode():
            out.append(([], [], [], []))
            continue
        spans = []
        for ids, parts in ((p, pb), (q, qb)):
            at, side = 0, []
            for k, s in zip(ids, parts):
                side.append((at, at + len(s), k))
                at += len(s)
            spans.append(side)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [tuple([k for s, e, k in side if low < e <= high] for side in spans) for low, high in zip([0, *cuts], cuts)]
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        out.append((p, q, groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    join = lambda v: ",".join(map(str, v))
    text = lambda g: hashlib.sha256(";".join(join(x) + "|" + join(y) for x, y in g).encode()).hexdigest() if g else ""
    return [(len(p), len(q), len(g), len(n), sum(counts[x] == best[x[1]] for x in n), sum(counts[x] for x in n), text(g)) for p, q, g, n in out]


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_equals_all_pairs(spark, hot):
    rows = texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, n_a string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align_corpus(docs, PATHS, hot_pairs=hot).collect()}
    want = dict(enumerate(plain(rows)))
    assert got == want
    assert sum(w[0] == 0 for w in want.values()) > 3 and max(w[3] - w[2] for w in want.values()) > 20


def test_small_batches_and_task_sums(spark, monkeypatch):
    rows = texts()
    a, b = alignment.byte_level(PATHS[0]), alignment.pieces(PATHS[1])
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    monkeypatch.setattr(alignment, "TASK_PAIRS", 20)
    docs = spark.createDataFrame([(7, t) for t in rows] + [(None, "again")], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r)[1:] for r in alignment.align_corpus(docs, PATHS).collect())
    assert got == sorted(plain([*rows, "again"]))
    assert len(a.entries) == 50_257 and len(b.entries) == 32_000


def test_bits():
    rng = np.random.default_rng(2)
    for size in (1, 63, 64, 65, 1000):
        places = np.unique(rng.integers(0, size, max(1, size // 3)))
        bits = alignment.Bits.of(places, size)
        assert bits.select().tolist() == places.tolist()
        at = np.arange(size + 1)
        assert bits.rank(at).tolist() == [int((places < k).sum()) for k in at]


def test_encoding_by_ranks_equals_the_file():
    """All characters that are encoded by ranks, beside each other and beside letters, digits, marks and spaces."""
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    chars = [chr(c) for c in range(0x250)]
    rng = random.Random(4)
    rows = [f"{x}{c}{y}{c}{c} {c}{x}  {c}" for c in chars for x, y in (("a", "b"), ("1", "x"), (".", " "), ("'", "s"), ("\n", "é"))]
    rows += ["".join(rng.choice(chars) for _ in range(60)) for _ in range(4000)] + ["a" * 5000, " " * 999, "1" * 999, "日本 x", "\U0001f642"]
    got = alignment.byte_level(PATHS[0]).encode(rows)
    assert got == [e.ids for e in t.encode_batch([" " + r for r in rows], add_special_tokens=False)]


def test_empty_table(spark):
    assert alignment.align_corpus(spark.createDataFrame([], "doc_id long, text string"), PATHS).collect() == []
