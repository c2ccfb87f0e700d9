"""Bit-sliced comparison against plain popcounts."""

import numpy as np

from paramloom.llm.components import Forest
from paramloom.llm.simhash import fingerprint, index_plan, link_cell, planes, within, within_runs


def _near(n, radius, seed):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**63, n, dtype=np.uint64)
    fp[n // 2 :] = fp[: n - n // 2]
    for i in range(n // 2, n):
        for b in rng.choice(64, rng.integers(0, 2 * radius + 2), replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    return fp


def test_within_equals_popcount():
    for radius in (0, 1, 3, 7, 9):
        fp = _near(301, radius, radius)
        got = {i: set(x.tolist()) for i, x in within(fp, planes(fp), len(fp), radius)}
        for i in range(len(fp)):
            assert got.get(i, set()) == set(np.nonzero(np.bitwise_count(fp ^ fp[i]) <= radius)[0].tolist())


def test_small_cells_behind_each_other_equal_popcount():
    rng = np.random.default_rng(5)
    for radius in (0, 3, 9):
        for most in (1, 2, 5, 63, 200):
            sizes = rng.integers(1, most + 1, 120)
            cell = np.repeat(rng.permutation(120), sizes)
            fp = _near(len(cell), radius, most)
            fp = fp[rng.permutation(len(fp))] & np.uint64(0xFFFF)
            got = {(int(a), int(b)) for i, j in within_runs(cell, fp, radius) for a, b in zip(i, j)}
            want = {(i, j) for i in range(len(cell)) for j in range(i + 1, min(i + most, len(cell))) if cell[i] == cell[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}
            assert got == want and all(a < b for a, b in got)
    assert list(within_runs(np.zeros(0, np.int64), np.zeros(0, np.uint64), 3)) == []


def test_cells_of_any_size_join_the_same():
    for n in (2, 10, 63, 64, 65, 300):
        fp, forest = _near(n, 3, n), Forest()
        ids = np.arange(n)
        link_cell(fp, ids, 3, forest)
        plain = Forest()
        for i in range(n):
            for j in range(i + 1, n):
                if int(fp[i] ^ fp[j]).bit_count() <= 3:
                    plain.join(i, j)
        assert [forest.root(i) for i in range(n)] == [plain.root(i) for i in range(n)]


def test_every_choice_of_wrong_bits_leaves_a_key():
    for n in (10, 10**5, 10**8):
        for radius in (3, 9):
            widths, choices = index_plan(n, radius)
            assert sum(widths) == 64
            lows = np.cumsum([0, *widths])
            rng = np.random.default_rng(n + radius)
            for _ in range(200):
                wrong = rng.choice(64, radius, replace=False)
                hit = {int(np.searchsorted(lows, b, side="right")) - 1 for b in wrong}
                assert any(hit.isdisjoint(c) for c in choices)


def test_fingerprint_cases():
    assert fingerprint(None, 3) == fingerprint("", 3) == fingerprint(" \t\n", 3) == 0
    assert fingerprint("A b", 3) == fingerprint("a  B", 3) != 0
    assert fingerprint("x " * 100_000, 3) == fingerprint("x x x", 3)
