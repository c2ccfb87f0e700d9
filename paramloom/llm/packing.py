"""Mixture-controlled packing of token streams into fixed-length sequences.

Deficit round-robin in closed form. Each source is a queue with its share of all tokens (after mixing, these are
the target proportions; as every token is packed, no other shares can hold to the end). Window w serves queue q
from floor(w * quota_q) to floor((w + 1) * quota_q): the fraction that a window could not serve is the deficit
that the next one starts with. So any task can place its own documents without seeing another's, across windows
and partitions. Windows follow each other without gaps and are cut into sequences, which are all full but the last.

A source whose share is below `least_quota` tokens a window has no queue of its own: such sources are one queue
together. So there are at most length / least_quota + 1 queues, whatever the number of sources. Within that queue each
source still has its schedule: its tokens go in stretches of `least_quota`, in the order of the share of the source
that has gone by then (plus a phase by the source's name, so that they don't all come at once). So a long document of
one small source doesn't hold up the others, and each is at any time within about two stretches of its proportion.

Defined cases: null and empty texts are the closing id alone; null is a source of its own; rows that repeat a
doc_id are documents of their own; a document longer than a sequence is cut like any other; no rows, no pieces.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

LENGTH = 4096
LEAST_QUOTA = 32
END_ID = 2
#: documents of a bucket within a queue, on average
BUCKET_ROWS = 500
#: bytes of text that are encoded together (a longer text stands alone), and words that a task keeps the ids of
BATCH_BYTES, _CACHE = 4 << 20, 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Byte-pair merging of many words at once.

    Words of like length are rows of a matrix of symbols; each step merges the first lowest-ranked pair of every
    row that still has one, which is the order in which the tokenizers library merges.
    """

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.rank = np.append(order.astype(np.int32), 0)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.uint16)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.uint16)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.uint32) << np.uint32(16) | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], np.int32(1 << 30))

    def run(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (UTF-8, not empty) as 16-bit integers."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 24), (24, 48), (48, 1 << 40)):
            group = np.nonzero((size >= low) & (size < high))[0]
            step = max(1, min(32_768, (1 << 21) // int(size[group].max(initial=1))))
            for at in range(0, len(group), step):
                pick = group[at : at + step]
                ids, n = self._rows([words[i] for i in pick], size[pick])
                flat = ids[np.arange(ids.shape[1])[None, :] < n[:, None]]
                all_, ends = flat.tobytes(), (2 * np.cumsum(n)).tolist()
                for i, s, e in zip(pick.tolist(), [0, *ends], ends):
                    out[i] = all_[s:e]
        return out

    def _rows(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        data = np.frombuffer(b"".join(words), np.uint8)
        filled = np.arange(width)[None, :] < size[:, None]
        ids = np.zeros((len(words), width), np.uint16)
        ids[filled] = self.inner[data]
        ends = np.cumsum(size) - 1
        ids[np.arange(len(words)), size - 1] = self.last[data[ends]]
        n = size.copy()
        if width == 1:
            return ids, n
        none = np.int32(1 << 30)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        rank[~filled[:, 1:]] = none
        live = np.arange(len(words))
        rows, ranks = ids, rank
        spots = np.arange(width)
        while True:
            best = ranks.argmin(1)
            low = ranks[np.arange(len(ranks)), best]
            more = low < none
            if not more.all():
                ids[live] = rows
                live, rows, ranks, best, low = live[more], rows[more], ranks[more], best[more], low[more]
                if not len(live):
                    return ids, n
            every = np.arange(len(live))
            # close the gap: columns after the pair move one to the left
            source = np.minimum(spots[None, :] + (spots[None, :] > best[:, None]), width - 1)
            rows = np.take_along_axis(rows, source, 1)
            rows[every, best] = self.made[low]
            source = np.minimum(spots[None, :-1] + (spots[None, :-1] >= best[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, source, 1)
            n[live] -= 1
            count = n[live]
            ranks[every, np.maximum(count - 1, 0)] = none
            ranks[:, -1] = none
            before = np.nonzero(best > 0)[0]
            ranks[before, best[before] - 1] = self.ranks(rows[before, best[before] - 1], rows[before, best[before]])
            after = np.nonzero(best < count - 1)[0]
            ranks[after, best[after]] = self.ranks(rows[after, best[after]], rows[after, best[after] + 1])


def _classes() -> np.ndarray:
    """Of code points below U+0280: 0 white space, 1 letter, 2 number, 3 other, 4 text end."""
    kinds = {"L": 1, "N": 2}
    found = np.array([0 if chr(c).isspace() else kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x280)], np.uint8)
    found[0] = 4
    return found


_CLASS = _classes()
_LEAD = np.arange(256) >= 0xCA
_ODD_BYTE = _LEAD.copy()
_ODD_BYTE[[0, 0x1C, 0x1D, 0x1E, 0x1F]] = True
#: second bytes after C2, C4, C8 of characters that the fast path leaves to the library
_ODD_PAIRS = ((0xC2, (0x85, 0xA0)), (0xC4, (0xB0,)), (0xC8, (0xBA, 0xBE)), (0x3C, (0x7C,)))


class Encoder:
    """Whole texts to ids, many at a time.

    The vocabulary's rule for words (letters, single numbers, runs of other marks, English contractions; no word
    spans white space) is applied to all texts at once as changes of character class; distinct words are merged
    together and cached. Texts with characters from U+0280 on, or with other rare ones, go through the library.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def odd(data: np.ndarray) -> np.ndarray:
        """Positions of bytes that the fast path does not take."""
        hits = [np.nonzero(_ODD_BYTE[data])[0]]
        for lead, nexts in _ODD_PAIRS:
            at = np.nonzero(data[:-1] == lead)[0]
            hits.append(at[np.isin(data[at + 1], nexts)])
        return np.concatenate(hits)

    @staticmethod
    def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end in lower-cased UTF-8, text ends (byte 0) included; and their bytes."""
        kind = _CLASS[data]
        lead = np.nonzero(data >= 0xC2)[0]
        kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
        change = np.ones(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 4)
        single = np.nonzero(kind == 2)[0]
        change[single[(data[single] & 0xC0) != 0x80]] = True
        quote = np.nonzero((data == 0x27) & change)[0]
        quote = quote[quote + 2 < len(data)]
        one = np.isin(data[quote + 1], np.frombuffer(b"stmd", np.uint8))
        pair = data[quote + 1].astype(np.int64) << 8 | data[quote + 2]
        two = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        for at, length in ((quote[one], 2), (quote[two], 3)):
            change[at + 1] = False
            change[at + length] = True
        starts = np.nonzero(change)[0]
        ends = np.append(starts[1:], len(data))
        full = kind[starts] != 0
        return starts[full], ends[full], data[kind != 0]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, each closed by end; and where each one begins (and the last ends)."""
        strings = [t or "" for t in texts.to_pylist()]
        raw = [t.encode("utf-8", "surrogatepass") for t in strings]
        bounds = np.cumsum([0, *(len(t) + 1 for t in raw)])
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        odd = sorted(set((np.searchsorted(bounds, self.odd(data), side="right") - 1).tolist())) if len(data) else []
        for i in odd:
            strings[i] = ""
        data = np.frombuffer("\0".join([*strings, ""]).lower().encode(), np.uint8)
        starts, ends, body = self.words(data)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        flat, table = self._table(words.dictionary.to_pylist(), end)
        ids = pa.ListArray.from_arrays(pa.array(table, pa.int32()), pa.array(flat)).take(words.indices)
        at = ids.offsets.to_numpy()
        ids = ids.flatten().to_numpy()
        closes = at[1:][data[starts] == 0]
        bounds = np.append(0, closes)
        if not odd:
            return ids.astype(np.uint32), bounds
        parts = [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i].as_py() for i in odd], add_special_tokens=False)):
            parts[i] = np.array([*e.ids, end], np.uint16)
        return np.concatenate(parts).astype(np.uint32), np.cumsum([0, *map(len, parts)])

    def _table(self, found: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words behind each other, and where each begins."""
        each = list(map(self.cache.get, found))
        new = [i for i, x in enumerate(each) if x is None]
        made = self.merges.run([found[i] for i in new])
        if len(self.cache) + len(new) > _CACHE:
            self.cache = {}
        if len(new) <= _CACHE:
            self.cache.update(zip((found[i] for i in new), made))
        for i, x in zip(new, made):
            each[i] = x if found[i] != b"\0" else np.uint16(end).tobytes()
        self.cache.pop(b"\0", None)
        return np.frombuffer(b"".join(each), np.uint16), np.cumsum([0, *map(len, each)]) // 2


def tokenize(docs: DataFrame, vocabulary: str, end: int = END_ID) -> DataFrame:
    """(doc_id, source, n, ids, tie): ids as compressed little-endian uint32 of a whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(2).slice(at)), 0).to_numpy(zero_copy_only=False))
                b = whole.slice(at, max(1, int(np.searchsorted(sizes, BATCH_BYTES, side="right"))))
                at += b.num_rows
                ids, bounds = encoder.encode(b.column(2), end)
                each = [ids[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array([press.compress(_planes(x)) for x in each], pa.binary()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                    ["doc_id", "source", "n", "ids", "tie"],
                )

    columns = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, source string, n long, ids binary, tie long")


def _planes(data: bytes) -> bytes:
    """Bytes of the same significance together: the upper ones are mostly zero and compress away."""
    return np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes()


class Schedule:
    """What each window serves: quotas a window by queue, and totals."""

    def __init__(self, totals: list[int], length: int = LENGTH) -> None:
        self.totals = np.array(totals, np.int64)
        self.windows = -(-int(sum(totals)) // length)
        self.quota = self.totals * (length / max(1, sum(totals)))

    def served(self, window: np.ndarray, queue: np.ndarray | None = None) -> np.ndarray:
        """Tokens that a queue (None: each) has given before a window."""
        w = np.asarray(window, np.int64)
        if queue is None:
            w = w[:, None]
            total, quota = self.totals[None, :], self.quota[None, :]
        else:
            total, quota = self.totals[queue], self.quota[queue]
        return np.where(w >= self.windows, total, np.minimum(total, np.floor(w * quota).astype(np.int64)))

    def window_of(self, queue: int, position: int) -> int:
        """The window that serves a position of a queue."""
        q = np.array([queue])
        w = min(self.windows - 1, max(0, int(position / self.quota[queue])))
        while w > 0 and self.served(np.array([w]), q)[0] > position:
            w -= 1
        while self.served(np.array([w + 1]), q)[0] <= position:
            w += 1
        return w

    def pieces(self, queue: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions begin <= p < end of a queue as runs: (first position, place in the line of all windows)."""
        first, last = self.window_of(queue, begin), self.window_of(queue, end - 1)
        w = np.arange(first, last + 1)
        at = self.served(w, np.full(len(w), queue))
        each, after = self.served(w), self.served(w + 1)
        place = each.sum(1) + (after - each)[:, :queue].sum(1)
        start = np.maximum(at, begin)
        keep = np.minimum(self.served(w + 1, np.full(len(w), queue)), end) > start
        return start[keep], (place + start - at)[keep]


def pack(docs: DataFrame, vocabulary: str | None = None, end: int = END_ID, length: int = LENGTH, least_quota: int = LEAST_QUOTA) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    tokens = materialize(tokenize(docs, vocabulary or default_vocabulary(), end), "tokens")
    return lay_out(tokens, length, least_quota)


def _interleaved(tail: DataFrame, sources: DataFrame, total: int, stretch: int) -> DataFrame:
    """(s, b, runs): for each document of the shared queue, by source and begin, its stretches (start, place in the queue).

    A stretch's key is the share of its source's tokens that has gone by then; buckets are ranges of the key, which
    hold about equal numbers of tokens whatever the sources are.
    """
    sums = sources.select(F.col("source").alias("s"), F.col("total").alias("all"))
    cut = tail.select("source", "begin", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(stretch).cast("long"))).alias("start"))
    cut = cut.join(sums, F.col("source").eqNullSafe(F.col("s"))).withColumn("size", F.least(F.lit(stretch), F.col("n") - F.col("start")))
    phase = F.pmod(F.xxhash64("source", F.lit(3)), F.lit(1 << 20)) / F.lit(1 << 20)
    key = (F.col("begin") + F.col("start") + F.col("size") * phase) / F.col("all")
    ranges = max(16, total // (stretch * BUCKET_ROWS))
    cut = cut.select("source", "begin", "start", "size", key.alias("key"))
    cut = cut.withColumn("range", F.least(F.floor(F.col("key") * ranges), F.lit(ranges - 1)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = cut.groupBy("range").agg(F.sum("size").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("key", "source", "begin", "start").rowsBetween(Window.unboundedPreceding, -1)
    put = cut.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(materialize(base, "ranges"), "range")
    run = F.struct("start", (F.col("base") + F.col("within")).alias("at"))
    return put.groupBy(F.col("source").alias("s"), F.col("begin").alias("b")).agg(F.array_sort(F.collect_list(run)).alias("runs"))


def lay_out(tokens: DataFrame, length: int = LENGTH, least_quota: int = LEAST_QUOTA, emit: Callable | None = None) -> DataFrame:
    sources = materialize(tokens.groupBy("source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")), "shares")
    total, rows = sources.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # at most length / least_quota sources hold that share of a window: a proven bound for what is collected and sent
    own = sources.where(F.col("total") >= F.lit(float(total) * least_quota / length)).orderBy(F.col("source").asc_nulls_last()).collect() if total else []
    totals = [int(x["total"]) for x in own] + [int(total) - sum(int(x["total"]) for x in own)]
    spark = tokens.sparkSession
    queues = spark.createDataFrame([(x["source"], i) for i, x in enumerate(own)], "s string, queue int")
    buckets = max(16, int(rows) // BUCKET_ROWS)
    dealt = tokens.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    dealt = dealt.withColumns({"queue": F.coalesce("queue", F.lit(len(own))), "bucket": F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets))})
    # where each document begins in its source
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("source", "bucket").agg(F.sum("n").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    base = materialize(base.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base"), "buckets")
    inside = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    small = base.limit(200_001).count() <= 200_000
    match = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    placed = dealt.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(base) if small else base, match)
    placed = placed.select("doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("within")).alias("begin"))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("begin").alias("at")))
    if totals[-1]:
        placed = materialize(placed, "placed")
        laid = _interleaved(placed.where(F.col("queue") == len(own)), sources, totals[-1], least_quota)
        tail = placed.where(F.col("queue") == len(own)).join(laid, F.col("source").eqNullSafe(F.col("s")) & (F.col("begin") == F.col("b")))
        placed = placed.where(F.col("queue") != len(own)).withColumn("runs", alone).unionByName(tail.drop("s", "b"))
    else:
        placed = placed.withColumn("runs", alone)
    placed = placed.select("doc_id", "source", "n", "ids", "queue", "runs")
    schedule = Schedule(totals, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: list[tuple] = []
                for i, source, n, packed, queue, runs in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                    data = _unplanes(unpress.decompress(packed))
                    stops = [r["start"] for r in runs[1:]] + [n]
                    for first, begin, stop in ((r["start"], r["at"], x) for r, x in zip(runs, stops)):
                        starts, places = schedule.pieces(queue, begin, begin + stop - first)
                        ends = np.append(starts[1:], begin + stop - first)
                        for s, e, p in zip((starts - begin + first).tolist(), (ends - begin + first).tolist(), places.tolist()):
                            while s < e:  # a run may cross from one sequence into the next
                                take = min(e - s, length - p % length)
                                out.append((i, s, take, zlib.crc32(data[4 * s : 4 * (s + take)]), n, p // length, p % length, source))
                                s, p = s + take, p + take
                kinds = [pa.int64()] * 7 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
