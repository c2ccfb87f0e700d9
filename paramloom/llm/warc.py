"""WARC archives: deduplicated writing, and reading by boundary-chain verification.

Writing: a payload's SHA-1 is taken in the scan; only (page_id, digest, length) is grouped, the smallest page_id
of a digest is the response and the others become revisit records. Spark's own text writer stores the records
(gzip), with the two line ends that close a record as its line separator, so any file system works.

Reading: Spark's text reader splits the files at the record magic wherever it stands, payloads included. Each
piece that starts like a record header is a candidate; tasks emit candidate offset -> successor offset, the end
that its Content-Length claims. A plain file is read in several splits: their lengths, one row a split, give every
split's offset, so chains go on from task to task. Pointer jumping from offset 0 of every file then keeps the reachable
records only. Jumps are first contracted within blocks of a file, so the joined table has a few rows per block. Only then are
payloads read: each split from its first reachable record on, each byte hashed once, however many false heads payloads
hold and whatever lengths they claim. Payloads that go on in another split are put together in order.

Defined cases: null html is the empty payload; equal payloads shorter than `least` bytes are all responses;
among rows with a digest's smallest page_id one is the response (the first in the archive's order) and rows that
repeat it are responses too; a null page_id is the largest; an empty table gives empty archives and no rows; a record
that the file's end cuts off, and one whose payload doesn't fit its digest, are read with `whole` false; a head whose
lengths have over 18 digits is none (such a record could lie in no file); other columns of pages are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import few, materialize, new_path

MAGIC = "WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
BLOCK = 4 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits in four groups of 40 bits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least: int = 0, compression: str = "gzip") -> None:
    """Write a record per row of pages (page_id, url, html) to files in path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    base = base.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    shared = base.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(shared.select("digest", "first"), "shared")
    hint = F.broadcast(shared) if few(shared, 200_000) else shared
    rows = base.join(hint, "digest", "left")
    again = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    head = lambda *lines: F.concat(F.lit(MAGIC), *[F.concat(*x, F.lit("\r\n")) for x in lines], F.lit("\r\n"))
    uid = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"), 256)
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(uid, 1, 32), r"(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))
    common = [
        (F.lit("WARC-Record-ID: "), record_id),
        (F.lit("WARC-Date: 1970-01-01T00:00:00Z"),),
        (F.lit("WARC-Target-URI: "), clean),
        (F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        (F.lit("X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
    ]
    block = F.concat(F.lit(HTTP), "html")
    response = F.concat(head((F.lit("WARC-Type: response"),), *common, (F.lit("Content-Type: application/http; msgtype=response"),), (F.lit("Content-Length: "), F.octet_length(block).cast("string"))), block)
    revisit = F.concat(
        head(
            (F.lit("WARC-Type: revisit"),), *common, (F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),),
            (F.lit("X-Payload-Length: "), F.col("size").cast("string")), (F.lit("X-Refers-To-Page: "), F.coalesce(F.col("first").cast("string"), F.lit(""))), (F.lit("Content-Length: 0"),),
        )
    )
    rows.select(F.when(again, revisit).otherwise(response).alias("value")).write.option("lineSep", CLOSE).option("compression", compression).text(path)


def _headers(piece: bytes) -> tuple[dict[bytes, bytes], int] | None:
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if b"warc-type" not in fields or b"warc-record-id" not in fields or _number(fields.get(b"content-length", b"")) is None:
        return None
    return fields, end + 4


def _number(digits: bytes) -> int | None:
    """A length of at most 18 ASCII digits."""
    return int(digits) if len(digits) <= 18 and digits.isdigit() else None


def _extent(fields: dict[bytes, bytes]) -> tuple[int, bool]:
    """The claimed length of a record's block, and whether an HTTP head stands before its payload."""
    length = _number(fields[b"content-length"])
    return length, fields.get(b"content-type", b"").startswith(b"application/http") and length > 0


class _Body:
    """SHA-1 and size of a payload that comes in parts; an HTTP block's head is left out."""

    def __init__(self, length: int, http: bool) -> None:
        self.left, self.size, self.sha, self.head = length, 0, hashlib.sha1(), b"" if http else None

    def feed(self, data: bytes) -> None:
        part = data[: self.left]
        self.left -= len(part)
        if self.head is not None:
            self.head += part
            cut = self.head.find(b"\r\n\r\n")
            if cut < 0 and self.left:
                return
            part, self.head = self.head[cut + 4 if cut >= 0 else 0 :], None
        self.sha.update(part)
        self.size += len(part)


_KINDS = {"file": pa.string(), "split": pa.int64(), "at": pa.int64(), "next": pa.int64(), "kind": pa.string(), "page": pa.string(), "refers": pa.string(), "told": pa.int64(), "said": pa.string(), "body_at": pa.int64(), "http": pa.bool_()}
_FOUND = "file string, split long, at long, next long, kind string, page string, refers string, told long, said string, body_at long, http boolean"


def _table(rows: list[tuple], kinds: dict = _KINDS) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, split, piece) in file order -> every candidate with its successor by offsets within the split, from
    its head alone. And a row a split: kind null, `next` its length."""
    magic = len(MAGIC)
    now, at = None, 0
    close = lambda: [] if now is None else [(*now, 0, at, *[None] * 7)]
    for b in batches:
        rows = []
        for name, split, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (name, split) != now:
                rows += close()
                now, at = (name, split), 0
            led = split > 0 or at > 0  # the record magic stands before this piece
            if led and (found := _headers(piece)):
                f, skip = found
                length, http = _extent(f)
                text = lambda name: f.get(name, b"").decode("latin1")  # noqa: B023,E731
                rows.append((*now, at - magic, at + skip + length + 4, text(b"warc-type"), text(b"x-page-id"), text(b"x-refers-to-page"), _number(f.get(b"x-payload-length", b"")), text(b"warc-payload-digest"), at + skip, http))
            at += len(piece) + magic
        yield _table(rows)
    yield _table(close())


_BODIES = {"file": pa.string(), "at": pa.int64(), "size": pa.int64(), "sha1": pa.binary()}


def _bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, split, start, data, entry, base) in file order, entry: where the split's first record on the chain
    starts -> (file, at, size, sha1) of the chain's payloads that end in their split."""
    now, expect, body, at = None, None, None, None
    for b in batches:
        rows = []
        for name, split, start, data, entry, base in zip(*(c.to_pylist() for c in b.columns)):
            if (name, split) != now:
                now, expect, body = (name, split), entry, None
            if body is not None:
                body.feed(data)
            elif start == expect and (found := _headers(data[len(MAGIC) :])):
                f, skip = found
                length, http = _extent(f)
                at, skip = start + base, skip + len(MAGIC)
                expect, body = start + skip + length + 4, _Body(length, http)
                body.feed(data[skip:])
            if body is not None and not body.left:
                rows.append((name, at, body.size, body.sha.digest()))
                body = None
        yield _table(rows, _BODIES)


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, piece) -> (file, split, start, data): the bytes of a split with their offsets in it, magic included."""
    now, at = None, 0
    for b in batches:
        starts, data = [], []
        for name, split, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (name, split) != now:
                now, at = (name, split), 0
            led = split > 0 or at > 0
            starts.append(at - len(MAGIC) if led else at)
            data.append(MAGIC.encode() + piece if led else piece)
            at += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["file", "split", "start", "data"])


def _joined_bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, at, length, http, data) sorted by (file, at, offset) -> (file, at, full_size, full_sha1), whole payloads only."""
    key, body = None, None

    def out() -> list[tuple]:
        return [(*key, body.size, body.sha.digest())] if body is not None and not body.left else []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], ["file", "at", "full_size", "full_sha1"])

    for b in batches:
        rows = []
        for f, a, length, http, data in zip(*(c.to_pylist() for c in b.columns)):
            if (f, a) != key:
                rows += out()
                key, body = (f, a), _Body(length, http)
            body.feed(data)
        yield batch(rows)
    yield batch(out())


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates sorted by (file, at descending) -> (file, block, at, exit): the chain's first offset beyond the block."""
    exits: dict[int, int] = {}
    now = None
    for b in batches:
        file, at, nxt = (c.to_pylist() for c in b.columns)
        out = []
        for f, a, n in zip(file, at, nxt):
            if (f, a // BLOCK) != now:
                now, exits = (f, a // BLOCK), {}
            exits[a] = exits.get(n, n) if n // BLOCK == a // BLOCK else n
            out.append(exits[a])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a // BLOCK for a in at], pa.int64()), b.column(1), pa.array(out, pa.int64())], ["file", "block", "at", "exit"])


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, at, next, entry) sorted by (file, at) -> those on the chain from their block's entry."""
    now, expect = None, None
    for b in batches:
        keep = []
        for f, k, a, n, e in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (f, k) != now:
                now, expect = (f, k), e
            keep.append(a == expect)
            if a == expect:
                expect = n
        yield b.filter(pa.array(keep))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in path: file, at, kind, page, refers, size, digest, whole (the digest fits the payload)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))
    placed = pieces.mapInArrow(_placed, "file string, split long, start long, data binary")
    told = materialize(pieces.mapInArrow(_candidates, _FOUND), "told")
    # where each split's first piece stands: one row a split
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = told.where("kind is null").select("file", "split", F.col("next").alias("length"), F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base"))
    splits = materialize(splits, "splits")
    hint = F.broadcast(splits) if few(splits, 100_000) else splits
    found = told.where("kind is not null").join(hint.select("file", "split", "base"), ["file", "split"])
    found = materialize(found.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "body_at")}), "candidates")
    by_block = F.floor(F.col("at") / BLOCK).cast("long")
    exits = found.select("file", "at", "next").repartition("file", by_block).sortWithinPartitions("file", F.desc("at")).mapInArrow(_contract, "file string, block long, at long, exit long")
    exits = materialize(exits, "exits")
    # pointer jumping over blocks: reach holds entries known to be on the chain, jump maps an offset 2^k blocks on
    reach = exits.where("at = 0").select("file", "at")
    jump = exits.select("file", "at", F.col("exit").alias("to"))
    targets = jump.select("file", F.col("to").alias("at")).distinct()
    starts = exits.where("at = 0").select("file", "at")
    jump = materialize(jump.join(targets.unionByName(starts).distinct(), ["file", "at"]), "jumps")
    while True:
        more = reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        more = more.join(jump, ["file", "at"], "left_semi")
        new = materialize(reach.unionByName(more).distinct(), "reach")
        if new.count() == (reach.count()):
            break
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = materialize(jump.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "jumps")
        reach = new
    entries = reach.select("file", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), F.col("at").alias("entry"))
    told = found.withColumn("block", by_block).join(entries, ["file", "block"])
    on_chain = told.select("file", "block", "at", "next", "entry", "kind", "page", "refers", "told", "said", "body_at", "http", "split", "base").repartition("file", "block").sortWithinPartitions("file", "at")
    on_chain = on_chain.mapInArrow(_walk, on_chain.schema)
    on_chain = materialize(on_chain, "chain")
    entries = materialize(on_chain.groupBy("file", "split", "base").agg(F.min(F.col("at") - F.col("base")).alias("entry")), "entries")  # one row a split
    if few(entries, 100_000):
        led = placed.join(F.broadcast(entries), ["file", "split"])  # rows stay in the files' order
    else:
        led = placed.join(entries, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "start")
    bodies = materialize(led.select("file", "split", "start", "data", "entry", "base").mapInArrow(_bodies, "file string, at long, size long, sha1 binary"), "bodies")
    on_chain = materialize(on_chain.join(bodies, ["file", "at"], "left"), "read")
    split = on_chain.where("sha1 is null").select("file", "at", "body_at", (F.col("next") - 4).alias("body_end"), "http")
    if split.limit(1).count():  # payloads that go on in other splits; a split holds parts of two of them at most
        wanted = split.join(splits, "file").where((F.col("body_at") < F.col("base") + F.col("length")) & (F.col("body_end") > F.col("base") - len(MAGIC)))
        wanted = materialize(wanted, "wanted")
        hint = F.broadcast(wanted) if few(wanted, 100_000) else wanted
        parts = placed.join(hint, ["file", "split"])
        start = F.col("start") + F.col("base")
        low, high = F.greatest(start, F.col("body_at")), F.least(start + F.octet_length("data"), F.col("body_end"))
        cut = F.substring(F.col("data"), (low - start + 1).cast("int"), (high - low).cast("int"))
        parts = parts.where(high > low).select("file", "at", low.alias("low"), (F.col("body_end") - F.col("body_at")).alias("left"), "http", cut.alias("data"))
        parts = parts.repartition("file", "at").sortWithinPartitions("file", "at", "low").select("file", "at", "left", "http", "data")
        whole = parts.mapInArrow(_joined_bodies, "file string, at long, full_size long, full_sha1 binary")
        on_chain = on_chain.join(whole, ["file", "at"], "left").withColumns({"size": F.coalesce("size", "full_size"), "sha1": F.coalesce("sha1", "full_sha1")})
    on_chain = on_chain.withColumn("size", F.when(F.col("sha1").isNotNull(), F.coalesce("told", "size")))
    digest = F.regexp_extract("said", r"^sha1:([A-Z2-7]{32})$", 1)
    fits = F.coalesce((F.col("kind") != "response") | (digest == _base32_of_binary(F.col("sha1"))), F.lit(False)) & F.col("sha1").isNotNull()
    return on_chain.select("file", "at", "kind", "page", "refers", F.coalesce("size", F.lit(0)).alias("size"), digest.alias("digest"), fits.alias("whole"))


def _base32_of_binary(value: Column) -> Column:
    digits = F.hex(value)
    groups = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    sound = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), F.col("file"))).cast("string"))
    return read(spark, path).withColumn("page", sound("page")).select(
        number("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers").alias("refers_to")
    )
