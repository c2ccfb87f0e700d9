"""What a worker holds while it counts evidence."""

import tracemalloc

import pyarrow as pa
import pytest

from paramloom.llm import toxicity


class Caught(Exception):
    pass


class Table:
    """Stands for a DataFrame; hands out the function that tasks run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        raise Caught


def counter(weigh):
    table = Table()
    with pytest.raises(Caught):
        toxicity._mine(table, weigh)
    return table.run


def test_evidence_is_held_by_slots_seen():
    batch = pa.RecordBatch.from_arrays([pa.array(["alpha beta", "alpha gamma"]), pa.array([True, False])], ["text", "toxic"])
    run = counter(lambda _, toxic: float(toxic))
    tracemalloc.start()
    list(run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # a table of all slots takes 134 MB


def test_sums_agree_however_often_they_are_put_out(monkeypatch):
    texts = [" ".join(f"word{k % 13} prefix{k % 7}x{k}" for k in range(n, n + 9)) for n in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, ""]), pa.array([n % 3 == 0 for n in range(41)])], ["text", "toxic"])

    def sums():
        found = {}
        for b in counter(lambda _, toxic: 0.75 if toxic else 0.25)([batch]):
            for slot, bad, good in zip(*(c.to_pylist() for c in b.columns)):
                old = found.get(slot, (0.0, 0.0))
                found[slot] = (old[0] + bad, old[1] + good)
        return found

    want = {-1: (0.0, 0.0)}
    for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
        words = {x for w in text.split() for x in toxicity._LETTERS.findall(w)}
        own = [s for w in words for s in toxicity.slots(w)]
        share = 0.75 if toxic else 0.25
        for s in {-1, *own, *(toxicity.at_level(s, k) for s in own for k in toxicity.LEVELS if own.count(s) >= k)}:
            old = want.get(s, (0.0, 0.0))
            want[s] = (old[0] + share, old[1] + 1 - share)
    assert sums() == want
    monkeypatch.setattr(toxicity, "HELD_SLOTS", 50, raising=False)
    assert sums() == want
