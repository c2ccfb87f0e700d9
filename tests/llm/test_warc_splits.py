"""Archives in plain files that are read in many splits, cut off or damaged; empty tables and odd rows."""

import numpy as np
import pytest

from paramloom.llm import warc
from paramloom.llm.scratch import new_path


def _pages(n=60):
    rng = np.random.default_rng(8)
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    return [(i, "u", fake * int(rng.integers(0, 4)) + "y" * int(rng.integers(0, 3000)) + f" {i % 50}") for i in range(n)] + [(n, "u", "z" * 40_000 + fake)]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_every_record_comes_back(spark, small_splits, compression):
    rows = _pages()
    path = new_path(spark, "plain")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, compression=compression)
    got = warc.read(spark, path).collect()
    assert sorted(int(r["page"]) for r in got) == [i for i, *_ in rows] and all(r["whole"] for r in got)
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    for r in got:
        html = rows[int(r["page"])][2]
        assert r["size"] == len(html) and r["kind"] == ("response" if first[html] == int(r["page"]) else "revisit")


def test_cut_and_damaged_records(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write(spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(5)], "page_id long, url string, html string").coalesce(1), path, compression="none")
    file = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part"))
    data = bytearray(file.read_bytes())
    data[data.index(b"page 1 page") + 3] ^= 1
    for crc in (tmp_path / "a").glob(".*.crc"):
        crc.unlink()
    file.write_bytes(bytes(data[:-40]))
    got = {int(r["page"]): r["whole"] for r in warc.read(spark, path).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False}


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, digest string, size int, kind string, first long"
    path = new_path(spark, "empty")
    warc.write(spark.createDataFrame([], schema), path)
    assert warc.read(spark, path).count() == 0
    path = new_path(spark, "odd")
    rows = [(None, None, None, "d", 1, "k", 2), (None, "u", "a", None, None, None, None), (1, "u\r\nv", "a", None, None, None, None), (1, "u", "a", None, None, None, None)]
    warc.write(spark.createDataFrame(rows, schema), path)
    got = sorted((r["page"], r["kind"], r["refers"], r["size"], r["whole"]) for r in warc.read(spark, path).collect())
    assert got == [("", "response", "", 0, True), ("", "revisit", "1", 1, True), ("1", "response", "", 1, True), ("1", "response", "", 1, True)]
