"""Scratch tables: discarded ones go from the shared folder, others stay readable."""

from pathlib import Path
from urllib.parse import urlparse

from paramloom.llm import scratch


def test_discard_deletes_only_the_given_table(spark):
    first, second = (scratch.materialize(spark.range(n), "test") for n in (3, 5))
    gone, kept = (path for _, path in scratch._written[-2:])
    on_disk = lambda path: Path(urlparse(path).path).exists()
    assert on_disk(gone) and on_disk(kept)
    scratch.discard(first)
    assert not on_disk(gone) and on_disk(kept)
    assert second.count() == 5
    paths = [path for _, path in scratch._written]
    assert gone not in paths and kept in paths
