"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (byte-level BPE) encodes space + text, B (pieces with byte fallback) the text, before which it sets the
space itself. The ends of the tokens of many documents, one behind another, are packed bitsets over their bytes:

* A AND B has the cuts where both end: they close the groups. Popcount ranks map a cut to the tokens before it.
* A OR B has the ends of stretches that lie in one token of each: every stretch is a link, since two tokens that overlap
  do so in one stretch. The ranks of its end are the two tokens.

Documents are encoded once; their ids are written to the shared folder. Links are made from the ids again wherever they
are needed: to count id pairs (added up by task before the shuffle), and to look up each document's counts. For that
the HOT_PAIRS most frequent pairs (a bound on what is broadcast, whatever the input) are sorted arrays in each task;
links of other pairs are added up by document and pair and joined by shuffle, in which no pair is frequent.

Defined cases: null and empty texts, and texts that B does not keep byte for byte, have no tokens: zeros and an empty
digest; strings of special tokens inside texts are plain text; rows that repeat a doc_id are documents of their own;
texts of any length are encoded whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: pairs that are broadcast (16 bytes each), distinct pairs that a task adds up before it passes them on
HOT_PAIRS, TASK_PAIRS = 1 << 20, 1 << 20
#: bytes of text that are encoded and aligned together (a longer text stands alone)
BATCH_BYTES = 2 << 20
#: fixed value: how byte-level BPE splits words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\x00-\u024f]").search


def _printable() -> dict[str, int]:
    """Characters of a byte-level vocabulary and their bytes: printable Latin-1 is itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


@dataclass(frozen=True)
class Tokens:
    """A tokenizer by its encoder of many texts and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    entries: list[bytes]
    lengths: np.ndarray


def byte_level(path: str) -> Tokens:
    """A byte-level BPE from its file.

    Where merges are in the order of ids and ids of single bytes come first, a BPE by ranks gives the same ids several
    times faster. It splits words by the same pattern; as classes of characters depend on the Unicode version a library
    was built with, it is only given texts without characters beyond U+024F (a test compares all of those)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters = _printable()
    entries = [b""] * t.get_vocab_size()
    for piece, k in t.get_vocab().items():
        entries[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    slow = lambda texts: [e.ids for e in t.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]
    return Tokens(_by_ranks(path, entries, letters, slow), entries, np.array([len(e) for e in entries], np.int64))


def _by_ranks(path: str, entries: list[bytes], letters: dict[str, int], slow: Callable) -> Callable[[list[str]], list[list[int]]]:
    """An encoder of space + text by ranks where the file allows it, else `slow`."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    vocab, step = given["model"]["vocab"], given["pre_tokenizer"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"]]
    in_order = all(vocab[x + y] == 256 + k for k, (x, y) in enumerate(merges)) and all(vocab[c] < 256 for c in letters)
    if not in_order or given["normalizer"] or step["type"] != "ByteLevel" or not step["use_regex"] or step["add_prefix_space"]:
        return slow
    ranks = {entries[k]: k for k in range(256 + len(merges))}
    fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def run(texts: list[str]) -> list[list[int]]:
        out: list = [None if _BEYOND(x) else fast.encode_ordinary(" " + x) for x in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, slow([texts[k] for k in rest]) if rest else []):
            out[k] = ids
        return out

    return run


def pieces(path: str) -> Tokens:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    text = lambda k: bytes([int(p.id_to_piece(k)[1:-1], 16)]) if p.is_byte(k) else p.id_to_piece(k).replace("▁", " ").encode()
    entries = [text(k) for k in range(p.vocab_size())]
    return Tokens(lambda texts: p.encode(texts, num_threads=1), entries, np.array([len(e) for e in entries], np.int64))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bits:
    """A bitset over byte offsets in 64-bit words, with popcounts before each word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each offset."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        padded = np.append(self.words, np.uint64(0))
        inside = padded[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside).astype(np.int64)

    def select(self) -> np.ndarray:
        """The offsets of all set bits."""
        return np.nonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[0]


@dataclass(frozen=True)
class Aligned:
    """Of documents one behind another: token ids, groups as cuts in both token streams, links as token places."""

    a: np.ndarray
    b: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray
    groups: np.ndarray  # of each document
    links: np.ndarray  # of each document

    def pairs(self) -> np.ndarray:
        """The id pair of each link, A's id in the upper half."""
        return self.a[self.a_links].astype(np.int64) << 32 | self.b[self.b_links]


def align(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray, ends: np.ndarray) -> Aligned:
    """Token ids of both sides over the same bytes; ends: where each document's bytes end (exclusive, ascending)."""
    size = int(ends[-1]) if len(ends) else 0
    one = Bits.of(np.cumsum(a_lengths[a]) - 1, size)
    two = Bits.of(np.cumsum(b_lengths[b]) - 1, size)
    shared, either = Bits(one.words & two.words), Bits(one.words | two.words)
    cuts, stops = shared.select(), either.select()
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    count = lambda bits: bits.rank(ends) - bits.rank(starts)
    return Aligned(a, b, one.rank(cuts + 1), two.rank(cuts + 1), one.rank(stops), two.rank(stops), count(shared), count(either))


def digests(x: Aligned, a_texts: list[bytes], b_texts: list[bytes]) -> list[str]:
    """SHA-256 of each document's groups: `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = len(x.a), len(x.b)
    a_group = np.repeat(np.arange(len(x.a_cuts)), np.diff(x.a_cuts, prepend=0))
    b_group = np.repeat(np.arange(len(x.b_cuts)), np.diff(x.b_cuts, prepend=0))
    order = np.empty(n_a + n_b, np.int64)
    # a group's A tokens come after the B tokens of earlier groups, its B tokens after its own A tokens
    order[np.arange(n_a) + np.concatenate(([0], x.b_cuts[:-1]))[a_group]] = x.a
    order[np.arange(n_b) + x.a_cuts[b_group]] = x.b.astype(np.int64) + len(a_texts)
    sign = np.zeros(n_a + n_b, np.int64)
    sign[x.a_cuts - 1 + np.concatenate(([0], x.b_cuts[:-1]))] = 1
    sign[x.b_cuts - 1 + x.a_cuts] = 2
    texts = a_texts + b_texts
    written = [t + s for s in (b",", b"|", b";") for t in texts]
    out, first, group = [], 0, 0
    codes = order + sign * len(texts)
    for groups in x.groups.tolist():
        group += groups
        last = int(x.a_cuts[group - 1] + x.b_cuts[group - 1])
        out.append(hashlib.sha256(b"".join(map(written.__getitem__, codes[first:last].tolist()))[:-1]).hexdigest())
        first = last
    return out


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of a string or binary column."""
    at, size, sizes = 0, 0, [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]
    for k, n in enumerate(sizes):
        if size and size + n > BATCH_BYTES:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _shared(lists: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(lists), np.uint16)


class _Vocabularies:
    """Both tokenizers, loaded once a Python process."""

    loaded: dict = {}

    @classmethod
    def get(cls, paths: tuple[str, str]) -> tuple[Tokens, Tokens]:
        if paths not in cls.loaded:
            cls.loaded[paths] = (byte_level(paths[0]), pieces(paths[1]))
        both = cls.loaded[paths]
        if max(len(t.entries) for t in both) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        return both


def encode(docs: DataFrame, paths: tuple[str, str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and both sides' ids (16-bit little-endian, in order)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _Vocabularies.get(paths)
        a_texts, b_texts = ([str(k).encode() for k in range(len(t.entries))] for t in (a, b))
        for whole in batches:
            for batch in _parts(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = list(zip(a.encode(texts), b.encode(texts)))
                for k, (t, (p, q)) in enumerate(zip(texts, ids)):
                    data = b" " + t.encode()
                    same = t and b"".join(map(a.entries.__getitem__, p)) == data and b"".join(map(b.entries.__getitem__, q)) == data
                    ids[k] = (p, q) if same else ([], [])
                ok = [k for k, (p, _) in enumerate(ids) if p]
                binary = [[np.array(side, "<u2").tobytes() for side in pair] for pair in ids]
                x = align(*(_shared([binary[k][side] for k in ok]) for side in (0, 1)), a.lengths, b.lengths, np.cumsum([len(texts[k].encode()) + 1 for k in ok]).astype(np.int64))
                groups, links, digest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), [""] * len(ids)
                groups[ok], links[ok] = x.groups, x.links
                for k, d in zip(ok, digests(x, a_texts, b_texts)):
                    digest[k] = d
                columns = [batch.column(0), pa.array([len(p) for p, _ in ids], pa.int64()), pa.array([len(q) for _, q in ids], pa.int64()), pa.array(groups), pa.array(links), pa.array(digest, pa.string())]
                columns += [pa.array([v[side] for v in binary], pa.binary()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a_ids", "b_ids"])

    given = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    return given.mapInArrow(run, f"`{id}` {given.schema[0].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary")


def _again(batch: pa.RecordBatch, a: Tokens, b: Tokens) -> Aligned:
    """The alignment of encoded rows, from their ids."""
    sides = [_shared(batch.column(name).to_pylist()) for name in ("a_ids", "b_ids")]
    bytes_before = np.concatenate(([0], np.cumsum(a.lengths[sides[0]])))
    tokens = np.cumsum(batch.column("n_a").to_numpy())
    # a document without tokens has no bytes; its end is the one before
    return align(*sides, a.lengths, b.lengths, bytes_before[tokens].astype(np.int64))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([p[1] for p in parts]))
    return keys, n


def pair_counts(encoded: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(pair, n, best): links that hold each id pair over all documents; best: no pair of its B id has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _Vocabularies.get(paths)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in parts[0]], names=["pair", "n"])

        for whole in batches:
            for batch in _parts(whole, 3):
                found = np.unique(_again(batch, a, b).pairs(), return_counts=True)
                parts.append((found[0], found[1].astype(np.int64)))
                held += len(found[0])
                if held > TASK_PAIRS:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if 2 * held > TASK_PAIRS:
                        yield out()
                        parts, held = [], 0
        if parts:
            parts = [_summed(parts)]
            yield out()

    part = encoded.select("n_a", "n_b", "a_ids", "b_ids").mapInArrow(run, "pair long, n long")
    counts = materialize(part.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    of_b = F.col("pair").bitwiseAND((1 << 32) - 1)
    top = counts.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_top"))  # at most one row an id of B
    return counts.withColumn("_b", of_b).join(top, "_b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _hot(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least count (a power of two) that at most `most` pairs reach, and those pairs, sorted."""
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 rows at most
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    rows = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    return least, tuple(rows[c].to_numpy()[order] for c in ("pair", "n", "best"))


def align_corpus(docs: DataFrame, paths: tuple[str, str], id: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair's count is the highest of its B id; count_sum: the sum of the counts over links."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, paths, id, text).withColumn("_row", F.monotonically_increasing_id()), "encoded")
    counts = materialize(pair_counts(encoded, paths), "counts")
    least, arrays = _hot(counts, hot_pairs)
    shared = spark.sparkContext.broadcast(arrays)
    ids = encoded.select("n_a", "n_b", "a_ids", "b_ids", "_row", f"`{id}`", "n_groups", "n_links", "groups_sha256")

    def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = shared.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        return at, (keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _Vocabularies.get(paths)
        _, n, best = shared.value
        for whole in batches:
            for batch in _parts(whole, 3):
                x = _again(batch, a, b)
                distinct, of = np.unique(x.pairs(), return_inverse=True)
                at, hit = known(distinct)
                value = np.where(hit, n[at] if len(n) else 0, 0)[of]
                top = (hit & (best[at] if len(n) else False))[of]
                ends = np.cumsum(x.links)
                total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[np.concatenate(([0], ends))])
                columns = [batch.column(c) for c in ("_row", id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total(top)), pa.array(total(value))], names=["_row", id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _Vocabularies.get(paths)
        for whole in batches:
            for batch in _parts(whole, 3):
                x = _again(batch, a, b)
                pairs, row = x.pairs(), np.repeat(np.arange(batch.num_rows), x.links)
                rest = ~known(pairs)[1]
                found, times = np.unique(np.stack([row[rest], pairs[rest]]), axis=1, return_counts=True)
                rows = batch.column("_row").to_numpy()[found[0]]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found[1]), pa.array(times.astype(np.int64))], names=["_row", "pair", "times"])

    kind = encoded.schema[id].dataType.simpleString()
    out = ids.mapInArrow(score, f"_row long, `{id}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if least:
        rest = ids.mapInArrow(others, "_row long, pair long, times long").join(counts.where(F.floor(F.log2("n")) < least), "pair")
        sums = rest.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
        out = out.join(sums, "_row", "left")
        for name, more in (("n_best", "_best"), ("count_sum", "_sum")):
            out = out.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return out.select(f"`{id}`", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_paths())
