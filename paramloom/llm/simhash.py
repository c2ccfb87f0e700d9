"""SimHash near-dedup: fingerprints compared in vertical bit planes with carry-save counters.

Every comparison is bit-sliced. In cells of a word's lanes or more each row is held against all lanes; smaller cells lie
one behind another in common planes, which are held against themselves shifted by one lane, two lanes and so on.

Fingerprints that differ in at most `radius` bits agree on some choice of blocks (pigeonhole), so every
link falls into at least one bucket (choice, block value). A bucket's rows are compared in bounded cells;
a cell emits a spanning forest of its links, never all pairs.

Defined cases: null or blank text has fingerprint zero and links like any other; texts with fewer words
than the shingle width are one shingle; equal fingerprints are one class (its smallest doc_id stands for it);
repeated rows keep their multiplicity; a null doc_id never becomes a component unless its class has no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, connected_components
from .scratch import few, materialize
from .shingles import majority, near_copies, shingle_hashes

BITS = 64
CELL = 2048
#: differing bits up to which the pipeline takes two fingerprints as candidates; links of others are found by prefixes
NEAR = 3


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of one text."""
    h = shingle_hashes(text, width)
    return int(majority(np.array(h, np.uint64), np.array([len(h)]))[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                each = [np.array(shingle_hashes(t.as_py(), width), np.uint64) for t in b.column(1)]
                fp = majority(np.concatenate(each), np.array([len(h) for h in each])).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def index_plan(n: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Block widths, and the choices of blocks used as keys: the cheapest that still covers every link.

    With B blocks, radius bits touch at most radius of them, so some choice of B - radius blocks is untouched.
    Cost: a microsecond a posting and some nanoseconds a comparison within a bucket.
    """
    best = None
    for blocks in range(radius + 1, min(BITS, radius + 6) + 1):
        keep = blocks - radius
        bits = BITS * keep // blocks
        cost = n * comb(blocks, keep) * (1.0 + 0.0025 * n / 2**bits)
        if best is None or cost < best[0]:
            best = (cost, blocks, keep)
    _, blocks, keep = best
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    return widths, list(combinations(range(blocks), keep))


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: planes[b] holds bit b of every fingerprint, 64 fingerprints to a word."""
    lanes = -(-len(fp) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(query: np.ndarray, table: np.ndarray, n: int, radius: int, step: int = 8) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row: the positions among n table lanes that differ in at most radius bits.

    Distances of 64 lanes a word are kept in carry-save counter planes; a sticky plane marks lanes beyond
    the radius, and words whose lanes are all beyond it are abandoned.
    """
    depth = (radius + 1).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    limit = 1 << depth
    for at in range(0, len(query), 128):
        q = query[at : at + 128]
        rows, words = np.divmod(np.arange(len(q) * table.shape[1]), table.shape[1])
        # counters start at 2^depth - radius - 1, so that they overflow exactly at radius + 1
        first = limit - radius - 1
        count = [np.full(len(rows), full if first >> k & 1 else 0, np.uint64) for k in range(depth)]
        beyond = np.zeros(len(rows), np.uint64)
        for bit in range(BITS):
            carry = table[bit][words] ^ np.where(q >> np.uint64(bit) & np.uint64(1), full, np.uint64(0))[rows]
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            beyond |= carry
            if bit % step == step - 1:
                live = beyond != full
                if not live.any():
                    rows = rows[:0]
                    break
                if live.sum() < 0.7 * len(live):
                    rows, words, beyond = rows[live], words[live], beyond[live]
                    count = [c[live] for c in count]
        if len(rows):
            near = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(near)
            pos = words[r] * 64 + lane
            ok = pos < n
            hit_rows, hit_pos = rows[r][ok], pos[ok]
            order = np.argsort(hit_rows, kind="stable")
            hit_rows, hit_pos = hit_rows[order], hit_pos[order]
            cuts = np.searchsorted(hit_rows, np.arange(len(q) + 1))
            for i in range(len(q)):
                if cuts[i] < cuts[i + 1]:
                    yield at + i, hit_pos[cuts[i] : cuts[i + 1]]


def within_runs(cell: np.ndarray, fp: np.ndarray, radius: int, step: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within the radius whose rows lie in one run of equal cell numbers, by distance in lanes.

    A word compares 64 neighbouring rows with those d lanes on. Lanes whose two rows lie in different runs are beyond
    from the start, words without another lane are never looked at, and runs of at most d rows leave the planes."""
    place = np.arange(len(fp))
    depth = (radius + 1).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = (1 << depth) - radius - 1
    cuts = np.concatenate(([0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]))
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    table = None
    for d in range(1, int(size.max(initial=1))):
        alive = size > d
        if table is None or 2 * alive.sum() < len(alive):
            cell, fp, place, size = cell[alive], fp[alive], place[alive], size[alive]
            table = np.pad(planes(fp), ((0, 0), (0, d // 64 + 66)))
        same = np.zeros(-(-len(fp) // 64) * 64, bool)
        same[: len(fp) - d] = cell[:-d] == cell[d:]
        beyond = ~np.packbits(same, bitorder="little").view(np.uint64)
        words = np.nonzero(beyond != full)[0]
        beyond = beyond[words]
        count = [np.full(len(words), full if first >> k & 1 else 0, np.uint64) for k in range(depth)]
        skip, low = d // 64, np.uint64(d % 64)
        for bit in range(BITS):
            moved = table[bit][words + skip] >> low
            if low:
                moved |= table[bit][words + skip + 1] << (np.uint64(64) - low)
            carry = table[bit][words] ^ moved
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            beyond |= carry
            if bit % step == step - 1:
                live = beyond != full
                if not live.any():
                    words = words[:0]
                    break
                if live.sum() < 0.7 * len(live):
                    words, beyond = words[live], beyond[live]
                    count = [c[live] for c in count]
        if len(words):
            near = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(near)
            at = words[w] * 64 + lane
            yield place[at], place[at + d]


def link_cell(fp: np.ndarray, ids: np.ndarray, radius: int, forest: Forest) -> None:
    """Join all rows of one bounded cell that lie within the radius of each other."""
    if len(fp) < 64:  # less than one word of lanes
        return link_runs(np.zeros(len(fp), np.int64), fp, ids, radius, forest)
    table = planes(fp)
    for i, hits in within(fp, table, len(fp), radius):
        mine = int(ids[i])
        for j in hits[hits > i]:
            forest.join(mine, int(ids[j]))


def link_runs(cell: np.ndarray, fp: np.ndarray, ids: np.ndarray, radius: int, forest: Forest) -> None:
    """Join all rows of each cell that lie within the radius of each other; a cell's rows lie together."""
    for i, j in within_runs(cell, fp, radius):
        for a, b in zip(ids[i].tolist(), ids[j].tolist()):
            forest.join(a, b)


def link_batches(radius: int):
    """mapInArrow over rows (cell, fp, id) sorted by cell: a spanning forest of the links of each cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = Forest(), None

        def solve(cell: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> None:
            cuts = np.concatenate(([0], np.nonzero(np.diff(cell))[0] + 1, [len(cell)]))
            size = np.diff(cuts)
            for i in np.nonzero(size >= 64)[0]:
                s = slice(cuts[i], cuts[i + 1])
                link_cell(fp[s], ids[s], radius, forest)
            small = np.repeat(size < 64, size)
            link_runs(cell[small], fp[small], ids[small], radius, forest)

        def out() -> pa.RecordBatch:
            a, b = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            now = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) and (np.diff(now[0]) >= 0).all() else 0
            if len(now[0]) and cut == 0 and now[0][0] != now[0][-1]:
                cut = int(np.nonzero(now[0] != now[0][-1])[0][-1]) + 1
            if cut:
                solve(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
            if len(forest.up) > 200_000:
                yield out()
                forest = Forest()
        if rest is not None and len(rest[0]):
            solve(*rest)
        yield out()

    return run


def links(classes: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect the classes (fp, id) exactly as all links within the radius do."""
    widths, choices = index_plan(max(1, classes.count()), radius)
    lows = np.concatenate(([0], np.cumsum(widths))).tolist()

    def block(i: int):
        return F.shiftrightunsigned("fp", lows[i]).bitwiseAND(F.lit((1 << widths[i]) - 1 if widths[i] < 64 else -1))

    keys = F.array(*[F.xxhash64(F.lit(t), *[block(i) for i in c]) for t, c in enumerate(choices)])
    posts = classes.select("fp", "id", F.explode(keys).alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = materialize(sizes.where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts")), "buckets")
    # buckets beyond one cell: rows fall into parts, and each pair of parts is a cell of its own
    hint = F.broadcast(large) if few(large, 100_000) else large
    dealt = posts.join(hint, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = lambda x: F.xxhash64("key", F.least(x.cast("long"), own), F.greatest(x.cast("long"), own))
    cells = dealt.select(F.explode(F.transform(others, pair)).alias("cell"), "fp", "id")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(link_batches(radius), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document row: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    marks = materialize(fingerprints(docs, width), "fingerprints")
    classes = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    found = connected_components(links(classes.where("id is not null"), radius))
    moved = found.where("node <> component").withColumnRenamed("node", "id")
    table = materialize(classes.join(moved, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "membership")
    return marks.join(table, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs that stay: of each group the row with the smallest doc_id (of repeated rows, one).

    Fingerprints that lie near each other (bit planes, as in near_duplicates) make candidates; a pair is linked if its
    five-word shingles have an exact Jaccard similarity of 0.8 or more. As many such pairs have fingerprints that lie
    further apart, the prefix join looks for all links between what is then still apart: groups are exact. Rows without a doc_id stay. Rows of one doc_id with different texts are documents of their own.
    """
    named, none = docs.where("doc_id is not null"), docs.where("doc_id is null")
    propose = lambda classes: links(classes, NEAR)
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if few(repeated, 0):
        kept = near_copies(named, width, propose).where("doc_id = component_id").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(none)
    # numbers of their own, written so that they stay the same; the row that stays is still that of the smallest doc_id
    numbered = materialize(named.withColumn("_key", F.monotonically_increasing_id()), "numbered")
    groups = near_copies(numbered.select(F.col("_key").alias("doc_id"), "text"), width, propose).withColumnRenamed("doc_id", "_key")
    order = F.struct("doc_id", F.xxhash64("text"), "_key")
    first = groups.join(numbered, "_key").groupBy("component_id").agg(F.min(order)["_key"].alias("_key"))
    return numbered.join(first, "_key", "left_semi").select(*docs.columns).unionByName(none)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
