"""Small cases of every corpus operator against brute force, with nulls, empty tables, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paramloom.llm import html, lines, mixing, packing, piecewise, simhash, toxicity, urlrules, vectors, warc
from paramloom.llm.scratch import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket int, queue string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choice(words, 12)) for _ in range(4))
        rows.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text), "x", 1, "y"))
    rows += [(100 + i, rows[i][1].replace("w1 ", "zz ", 1), "en", "s0", 1, None, None, None) for i in range(10)]
    rows += [(200, None, None, None, None, None, None, None), (201, "", "en", "s1", 0, "", 0, ""), (202, " \n\t", "en", "s1", 3, "", 0, ""), (203, "word " * 30_000, "en", "s2", 1, "", 0, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_simhash_groups(docs, empty):
    rows = simhash.near_duplicates(docs, 3, 9).collect()
    fp = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows}
    comp = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            comp[i] = min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 9)
    assert {r["doc_id"]: r["component_id"] for r in rows} == comp
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup(docs).columns == docs.columns


def test_lines_equal_brute_force(docs, empty):
    gone, seen = {}, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        keep = []
        for line in (r["text"] or "").split("\n"):
            s = frozenset(line.lower().split())
            if s and any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                continue
            keep.append(line)
        for line in (r["text"] or "").split("\n"):
            if line.split():
                seen.append(frozenset(line.lower().split()))
        gone[r["doc_id"]] = None if r["text"] is None else "\n".join(keep)
    # lines of one document also meet each other
    got = {r["doc_id"]: r["text"] for r in lines.line_dedup(docs).collect()}
    assert got == gone
    assert lines.line_dedup(empty).count() == 0
    again = lines.line_dedup(docs.unionByName(docs)).collect()
    assert len(again) == 2 * len(got) and all(r["text"] == got[r["doc_id"]] for r in again)


def test_mixing_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) / 2 + 1
    assert mixing.mix(empty).count() == 0


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    pieces = packing.pack(docs, length=512).collect()
    by, seq = {}, {}
    for p in pieces:
        by.setdefault(p["doc_id"], []).append(p)
        seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(by[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for s, parts in seq.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 512 or s == max(seq)
    assert packing.pack(empty).count() == 0


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.default_vocabulary()), packing.Encoder(packing.default_vocabulary())
    texts = ["", " ", "It's we'll I'M 12 a1b2 don't 'tis", "Ångström naïve ÉÈ ß", "á ΣΑΣ “x” 漢字", "<|endoftext|> <|ENDOFTEXT|>", "x\x1cy\x00z\x85 İ Ⱥ", "e" * 500 + "!!!", None]
    ids, at = own.encode(pa.array(texts), 2)
    for t, s, e in zip(texts, at[:-1], at[1:]):
        assert ids[s:e].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2], t


def test_fingerprints_and_successors(docs, empty):
    got = {r["doc_id"]: r for r in piecewise.with_successor(docs).collect()}
    ordered = sorted(docs.collect(), key=lambda r: r["doc_id"])
    for k, r in enumerate(ordered):
        text, after = r["text"] or "", ordered[(k + 1) % len(ordered)]["text"] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert g["fingerprint"] == piecewise.fingerprint(text.encode()) and 0 <= g["near_edited"] <= 1
    assert piecewise.with_successor(empty).count() == 0
    assert piecewise.distance("kitten", "sitting") == 3 and piecewise.likeness("1::", "1::") == 1


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    near = base[:20] + 0.15 * rng.normal(size=(20, 8))
    x = np.concatenate([base, near, near[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [float("nan")] * 8), (93, []), (94, [1.0, None]), (95, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in vectors.range_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    comp = np.arange(len(x))
    for _ in x:
        comp = np.array([comp[link[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (link[i].sum() - 1, comp[i])
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(90, 96))


def test_urls(spark):
    rows = [(1, "http://a.NET/x"), (2, "https://www.example.net/en/1?q"), (3, "http://example.com/de/"), (4, "http://x.org/fr/a#b"), (5, None), (6, "no scheme"), (7, "http://net"), (8, "http://spam-farm.example.org/en/1"), (9, "http://anet/")]
    out = urlrules.judge(spark.createDataFrame(rows, "page_id long, url string"), urlrules.STATED + urlrules.PATTERNS).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["best"] and r["best"]["name"], r["best"] and r["best"]["verdict"]) for r in out}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("", "", None, None) == got[6] and got[7] == ("net", "", None, None) and got[8][3] == "block" and got[9][2] is None


def test_html_cases():
    page = "<body><nav><p>menu</p></nav><article class='post'><header><h1>A &amp; B</h1></header><p>x <b>y</b>\n z<br>t<aside>no</aside><form>no</form><script>if(a<b){'</p>'}</script><section class='comments'><p>no</p></section><p>last</article><footer>f</footer>"
    assert "\n".join(t for p, t in html.blocks(page) if p == html.BODY) == "A & B\nx y z t\nlast"
    assert html.blocks(None) == [] == html.blocks("")
    tokens = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 20, 21, 1, 2, 3, 4, 5, 6, 7, 8, 9, 30])
    owner = np.array([0] * 11 + [1] * 10)
    hit = html.repeated(tokens, owner, owner, 8)
    assert hit.tolist() == [True] * 9 + [False] * 2 + [True] * 9 + [False]


def test_warc_round_trip(spark):
    fake = "a WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n tail"
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", fake), (6, "u", "é" * 1000), (7, "u", fake)]
    path = new_path(spark, "test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {int(r["page"]): r for r in warc.read(spark, path).collect()}
    assert set(got) == set(range(1, 8)) and all(r["whole"] for r in got.values())
    assert {i: r["kind"] for i, r in got.items()} == {1: "response", 2: "revisit", 3: "response", 4: "revisit", 5: "response", 6: "response", 7: "revisit"}
    assert got[7]["refers"] == "5" and got[5]["size"] == len(fake.encode()) == got[7]["size"]


def test_toxicity(spark, docs, empty):
    bad = "you are a worthless idiot and a pathetic moron"
    text = F.when(F.col("doc_id") % 4 == 0, F.concat_ws(" ", "text", F.lit(bad))).otherwise(F.col("text"))
    d = docs.withColumn("text", text)
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    bias, weights = toxicity.fit(d, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, bias, weights, "doc_id").collect()}
    assert min(s for i, s in got.items() if i % 4 == 0) > max(s for i, s in got.items() if i % 4)
    bias, weights = toxicity.fit(empty, labels.where("false"))
    assert toxicity.score(empty, bias, weights, "doc_id").count() == 0
    assert re.fullmatch(r"[01]\.\d+(e-\d+)?", str(got[201]))
