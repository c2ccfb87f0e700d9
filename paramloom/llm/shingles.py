"""Exact near-dedup by the Jaccard similarity of word shingles: a prefix-filter join.

A document is the set of its shingles' 64-bit hashes; documents of equal sets (by a 128-bit hash of the sorted set) are
one class, whose smallest doc_id stands for it. Two classes are linked if their similarity is 0.8 or more, and the
components of all links are the groups. Shingles are ordered by rarity: by how often their slot (65,536 of them, a
fixed bound) occurs in all documents, then by the hash. Two sets of similarity t share one of their first
n - ceil(t n) + 1 shingles; postings of those are joined under the length and the positional filter (both exact), and
the survivors' whole sets are compared.

Near fingerprints may propose pairs first (SimHash, by `propose`); those that the whole sets confirm are links, and the
join need not compare within their components.

Postings first meet the earliest document of their shingle only (a star, not all pairs); pairs that those links have
put into one component need no comparison any more, all others follow. So the components are those of all links.

Defined cases: documents without words are one class, linked to no other; a text of fewer words than the width is one
shingle; rows that repeat a doc_id are one document with the links of each of its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, few, materialize

SEED = 42
SLOTS = 1 << 16
BROADCAST_ROWS = 1_000_000
#: pairs up to which they are verified at once; more are dealt into parts, one after the other, MOST_PARTS at most
PART_PAIRS = 200_000
MOST_PARTS = 16


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every word shingle of a whole text, repeats included (A-Z lower-cased, ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    flat = b" ".join(words)
    gaps = np.nonzero(np.frombuffer(flat, np.uint8) == 32)[0]
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    return list(map(xxhash.xxh64_intdigest, [flat[s:e] for s, e in zip(starts, ends)], repeat(SEED)))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document the bits set in over half of its hashes; sizes: hashes of each document, in order.

    Eight byte-wide counters share a word and are emptied every 255 rows, before they overflow.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.nonzero(sizes)[0]
    if not len(full):
        return out
    n = sizes[full]
    parts = -(-n // 255)
    begins = np.cumsum(n) - n
    first = np.cumsum(parts) - parts
    cuts = np.repeat(begins, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.uint64(0x0101010101010101)
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        counts = np.add.reduceat(hashes >> np.uint64(k) & lanes, cuts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(counts.astype(np.int64), first, axis=0)
        for byte in range(8):
            bits |= (2 * ones[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = bits
    return out


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _slot_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How often each slot occurs in the sets of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                each = np.concatenate([shingle_set(t.as_py(), width) for t in whole.column(1).slice(at, 256)])
                count += np.bincount((each % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], ["slot", "n"])

    count = np.zeros(SLOTS, np.int64)
    sums = materialize(_columns(docs).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")), "slots")
    for slot, n in sums.collect():  # SLOTS rows at most
        count[slot] = n
    discard(sums)
    return count


def _prefixes(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, s1, s2, fp, prefix): size and 128-bit hash of each document's set, SimHash of its shingles, and its rarest ones."""
    count = _slot_counts(docs, width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sizes, one, two, fp, prefix = [], [], [], [], []
                for t in b.column(1):
                    every = np.array(shingle_hashes(t.as_py(), width), np.uint64)
                    h = np.unique(every)
                    fp.append(majority(every, np.array([len(every)])).view(np.int64)[0])
                    key = xxhash.xxh3_128_digest(h.tobytes())
                    sizes.append(len(h))
                    one.append(int.from_bytes(key[:8], "little", signed=True))
                    two.append(int.from_bytes(key[8:], "little", signed=True))
                    # prefix: n - ceil(0.8 n) + 1; the sort is stable and h in order
                    order = np.argsort(count[(h % np.uint64(SLOTS)).astype(np.int64)], kind="stable")
                    prefix.append(h[order[: len(h) - (4 * len(h) + 4) // 5 + 1]].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(fp, pa.int64()), lists], ["id", "n", "s1", "s2", "fp", "prefix"])

    return _columns(docs).mapInArrow(run, "id long, n int, s1 long, s2 long, fp long, prefix array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, t): the whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                each = [shingle_set(t.as_py(), width).view(np.int64) for t in b.column(1)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "t"])

    return _columns(docs).mapInArrow(run, "id long, t array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least 0.8: 9 * overlap >= 4 * (n + m)."""
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    hint = F.broadcast(wanted) if few(wanted, BROADCAST_ROWS) else wanted
    sets = materialize(_sets(docs.join(hint, "doc_id", "left_semi"), width), "sets")
    a, b = sets.withColumnRenamed("id", "a"), sets.select(F.col("id").alias("b"), F.col("t").alias("u"))
    overlap = F.size(F.array_intersect("t", "u"))
    # a join writes the sets of either end and a set a pair to disk, which goes with each part's end: two parts a set a pair
    parts = 1 if few(pairs, PART_PAIRS) else min(MOST_PARTS, -(-2 * pairs.count() // max(1, wanted.count())))
    found = []
    for part in range(parts):
        mine, ours, theirs = pairs, a, b
        if parts > 1:
            own = F.pmod(F.xxhash64("a", F.lit(3)), F.lit(parts)) == part
            mine, ours = pairs.where(own), a.where(own)
            theirs = b.join(mine.select("b").distinct(), "b", "left_semi")
        close = mine.join(ours, "a").join(theirs, "b").where(9 * overlap >= 4 * (F.size("t") + F.size("u")))
        found.append(materialize(close.select("a", "b").distinct(), "links"))
    found = reduce(DataFrame.unionByName, found)
    discard(pairs, wanted, sets)
    return found


def _fits() -> Column:
    """Length and positional filter on sets of n and m shingles that share the i-th of one and the j-th of the other."""
    low, high = F.least("n", "m"), F.greatest("n", "m")
    # overlap needed: 4/9 (n + m); at most what both have from this shingle on, and what both have before it
    most = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + F.least("i", "j")
    return (5 * low >= 4 * high) & (9 * most >= 4 * (F.col("n") + F.col("m")))


def _proposed(ours: DataFrame, docs: DataFrame, width: int, propose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links among pairs that propose() makes of (fp, id), an id a fingerprint, and of those ids and others of their fingerprint."""
    firsts = materialize(ours.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")), "fps")
    more = firsts.where("k > 1").select("fp", F.col("id").alias("b"))
    equal = ours.join(F.broadcast(more) if few(more, BROADCAST_ROWS) else more, "fp").where("id <> b").select(F.col("id").alias("a"), "b")
    return _verified(propose(firsts.select("fp", "id")).where("a <> b").unionByName(equal), docs, width)


def near_copies(docs: DataFrame, width: int = 5, propose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; component_id: the smallest doc_id reachable."""
    docs = docs.where("doc_id is not null")
    marks = materialize(_prefixes(docs, width), "prefixes")
    classes = materialize(marks.groupBy("s1", "s2").agg(F.min("id").alias("first")), "classes")
    # rows that repeat a doc_id and a set go here, not as postings; by doc_id too, as a set may have many copies
    same = ["id", "s1", "s2"]
    ours = marks.where("n > 0").join(classes.withColumnRenamed("first", "id"), same, "left_semi").dropDuplicates(same)
    held = materialize(ours.select("id", "n", "fp", "prefix"), "ours")
    names = materialize(marks.select("id", "s1", "s2"), "names")
    discard(marks)
    posts = held.select("id", "n", F.posexplode("prefix").alias("i", "token"))
    heads = posts.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "n", "i")).alias("head")).where("k > 1")
    heads = materialize(heads.select("token", "k", F.col("head.id").alias("first"), F.col("head.n").alias("m"), F.col("head.i").alias("j")), "heads")
    hint = F.broadcast(heads) if few(heads, BROADCAST_ROWS) else heads
    shared = materialize(posts.join(hint, "token"), "shared")
    ours = materialize(held.select("id", "fp"), "prints")
    discard(held, heads)
    pairs = shared.where("id <> first").where(_fits()).select(F.col("id").alias("a"), F.col("first").alias("b"))
    if propose:
        proposed = _proposed(ours, docs, width, propose)
        known = materialize(connected_components(proposed), "known")
        hint = F.broadcast(known) if few(known, BROADCAST_ROWS) else known
        for end in ("a", "b"):
            pairs = pairs.join(hint.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end, "left")
        apart = F.coalesce("in_a", "a") != F.coalesce("in_b", "b")
        star = _verified(pairs.where(apart).select("a", "b"), docs, width).unionByName(proposed)
    else:
        star = _verified(pairs, docs, width)
    # the others: pairs without the star's centre that are not in one component already
    group = connected_components(star).select(F.col("node").alias("id"), F.col("component").alias("group"))
    group = materialize(group, "groups")
    hint = F.broadcast(group) if few(group, BROADCAST_ROWS) else group
    rest = shared.where("k > 2 and id <> first").select("token", "id", "n", "i").join(hint, "id", "left")
    rest = rest_ = materialize(rest.withColumn("group", F.coalesce("group", "id")), "rest")
    # shingles whose postings lie in one component have nothing left to compare
    open_ = rest.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    rest = rest.join(open_, "token", "left_semi")
    other = rest.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("group").alias("other"))
    pairs = rest.join(other, "token").where((F.col("id") > F.col("b")) & (F.col("group") != F.col("other"))).where(_fits())
    more = _verified(pairs.select(F.col("id").alias("a"), "b"), docs, width)
    discard(shared, rest_)
    found = connected_components(star.unionByName(more))
    moved = found.where("node <> component").withColumnRenamed("node", "first")
    table = materialize(classes.join(moved, "first", "left").select("s1", "s2", F.coalesce("component", "first").alias("component_id")), "membership")
    return names.join(table, ["s1", "s2"]).select(F.col("id").alias("doc_id"), "component_id")
