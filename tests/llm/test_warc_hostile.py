"""Payloads that hold heads of records with any lengths, and a plain reader beside the operator's."""

import base64
import gzip
import hashlib
import time

import pytest

from paramloom.llm import warc
from paramloom.llm.scratch import new_path

HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {}\r\n{}\r\n"
LENGTHS = ["9223372036854775807", "9" * 25, "9" * 5000, "999999999999999999", "0", "-1", "\u0663", "1", "40"]


def page(length, more="", times=1):
    return "before " + HEAD.format(length, more) * times + "HTTP/1.1 200 OK\r\n\r\nafter \r\n\r\n"


def plain(folder):
    """Records by their lengths alone, from the start of each file: (page, kind, payload)."""
    out = []
    for f in sorted(folder.iterdir()):
        if not f.name.startswith("part"):
            continue
        data = gzip.decompress(f.read_bytes()) if f.name.endswith(".gz") else f.read_bytes()
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
            body = data[end + 4 : end + 4 + int(fields[b"Content-Length"])]
            assert data[end + 4 + len(body) : end + 8 + len(body)] == b"\r\n\r\n"
            out.append((fields[b"X-Page-Id"].decode(), fields[b"WARC-Type"].decode(), body.split(b"\r\n\r\n", 1)[-1]))
            at = end + 8 + len(body)
    return out


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_any_length_in_a_payload(spark, tmp_path, compression):
    rows = [(k, "u", page(n) + str(k)) for k, n in enumerate(LENGTHS)] + [(100 + k, "u", page(5, f"X-Payload-Length: {n}\r\n") + str(k)) for k, n in enumerate(LENGTHS)]
    rows += [(k + 200, "u", f"clean {k}") for k in range(30)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = f"{tmp_path}/a"
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, compression=compression)
        got = sorted((int(r["page"]), r["kind"], r["size"], r["digest"], r["whole"]) for r in warc.read(spark, path).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert got == sorted((int(p), k, len(b), sha(b), True) for p, k, b in plain(tmp_path / "a")) == sorted((i, "response", len(h.encode()), sha(h.encode()), True) for i, _, h in rows)


def test_ten_thousand_false_heads_cost_no_more_than_their_bytes(spark):
    rows = [(1, "u", page(10**15, times=10_000)), (2, "u", "x"), (3, "u", page(3, times=10_000))]
    path = new_path(spark, "heads")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    began = time.time()
    got = {int(r["page"]): (r["size"], r["whole"]) for r in warc.read(spark, path).collect()}
    assert got == {i: (len(h), True) for i, _, h in rows} and time.time() - began < 60
