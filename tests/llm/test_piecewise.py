"""Fingerprints and likeness against loops over bytes and letters; odd rows."""

import hashlib
import random

import pytest

from paramloom.llm import piecewise as P

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_fingerprint(data):
    n = len(data)
    if not n:
        return "1::"
    rolls = []
    for i in range(n):
        r = sum(data[i - j] * pow(0x01000193, j + 1, 1 << 32) for j in range(7) if i >= j) % (1 << 32)
        r ^= r >> 15
        r = r * 0x85EBCA6B % (1 << 32)
        rolls.append(r ^ r >> 13)

    def letters(block):
        out, value = "", 0
        for i, c in enumerate(data):
            value = (value * 0x100000001B3 + c) % (1 << 64)
            if rolls[i] % block == 0 or i == n - 1:
                out += LETTERS[(value * 0x9E3779B97F4A7C15) % (1 << 64) >> 58]
                value = 0
        return out

    block = 1
    while block < n // 64:
        block *= 2
    while len(letters(block)) < 32 and block > 1:
        block //= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, *s), (y, *t) = a.split(":"), b.split(":")
    pairs = [(p, q) for m, p in zip((int(x), 2 * int(x)), s) for k, q in zip((int(y), 2 * int(y)), t) if m == k]
    return max((1.0 if p == q else 1 - plain_distance(p, q) / max(len(p), len(q)) for p, q in pairs), default=0.0)


def texts():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghiß漢") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    long = " ".join(rng.choice(words) for _ in range(900))
    out = ["", "a", "ab" * 40, "x" * 5000, long, long[: len(long) // 2], long.replace(words[3], "other"), long.replace(" ", "  ")]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(25)]
    return out + [t[:-3] + "end" for t in out[8:14]]


def test_fingerprints_equal_plain_loops():
    for t in texts():
        assert P.fingerprint(t.encode()) == plain_fingerprint(t.encode())


def test_likeness_is_by_edit_distance():
    prints = [P.fingerprint(t.encode()) for t in texts()]
    for a in prints:
        for b in prints[::3]:
            assert P.likeness(a, b) == pytest.approx(plain_likeness(a, b))
    rng = random.Random(1)
    a = "".join(rng.choice(LETTERS) for _ in range(60))
    b = "".join(c if k % 4 else "!" for k, c in enumerate(a))  # every fourth letter is another: no run of five is shared
    assert P.likeness(f"64:{a}:x", f"64:{b}:y") == 0.75


def test_rows_and_their_successors(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "again", "y"), (None, "none", "z"), (None, None, "z"), (50, None, None)]
    got = P.with_successor(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)).collect()
    assert len(got) == len(rows)
    # compressed bytes order rows of one doc_id, so only rows told apart by doc_id have a known successor
    order = sorted({r[0] for r in rows if r[0] is not None})
    alone = {i: t or "" for i, t, _ in rows if sum(r[0] == i for r in rows) == 1}
    found = {r["doc_id"]: r for r in got}
    checked = 0
    for i, j in zip(order, [*order[1:], None]):
        if i in alone and j in alone:
            a, b = alone[i], alone[j]
            cut = len(a) // 4
            edited = (a[: len(a) - cut] + b[:cut]).encode()
            fp, ep, np_ = (plain_fingerprint(x) for x in (a.encode(), edited, b.encode()))
            r = found[i]
            assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (len(a), fp, ep, hashlib.sha256(edited).hexdigest())
            assert r["near_edited"] == pytest.approx(plain_likeness(fp, ep)) and r["near_next"] == pytest.approx(plain_likeness(fp, np_))
            checked += 1
    assert checked > 30
