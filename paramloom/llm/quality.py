"""Quality rules: counts over a text's words and lines, and bands of its compression ratio.

A text is compressed with zstandard as a whole and in fixed chunks of its UTF-8. A ratio (bytes before over bytes after)
above the band of its length means repetition, one below it random or encoded matter (keys, base64, noise). Short texts
compress less than long ones of the same kind, so each length has its own band; below 64 bytes there is none. A text is
refused if its whole ratio leaves the band, or if chunks that leave theirs hold over CHUNK_SHARE of its bytes.

Every text is measured by itself in the task that reads it: no shuffle, one text at a time in memory.

Defined cases: null and empty texts have no words and fail the base rule; rows that repeat a doc_id are judged each;
texts of any length are measured whole; an empty table gives no rows; columns of the input stay, except those whose
names the measures take.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE, SYMBOLS, WINDOW = b" \t\n\x0b\x0c\r", b"#*$%&|<>", 5
LEAST_WORDS, MOST_REPEATED = 10, 20
LEVEL, CHUNK, CHUNK_SHARE = 3, 4096, 0.25
#: From so many bytes on (up to the next line's), the lowest and the highest ratio of zstandard level 3.
#: Base64 gives 1.14 at 400 bytes, 1.22 at 700, 1.28 at 1,500 and 1.33 from 16,000 on; prose gives 1.3 to 1.7 at 400
#: bytes, 1.4 to 2 at 700, 1.7 to 2.3 at 1,500, 2 to 2.6 at 4,096 and 2.3 to 3.5 beyond.
BANDS = (
    (0, 0.0, float("inf")),
    (64, 0.0, 2.5),
    (256, 1.10, 3.0),
    (512, 1.22, 3.5),
    (1024, 1.32, 4.0),
    (4096, 1.40, 5.0),
    (65536, 1.40, 6.0),
)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, bytes_repetitive long, bytes_incompressible long, kept boolean"
_NAMES = [m.split()[0] for m in MEASURES.split(", ")]


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more (its first place included)."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, kinds = ids[:n], len(number)
    for k in range(1, width):  # windows are numbered exactly: by place value, and anew before a number can overflow
        if kinds > (1 << 62) // len(number):
            key = np.unique(key, return_inverse=True)[1]
            kinds = n
        key, kinds = key * len(number) + ids[k : n + k], kinds * len(number)
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.nonzero(count[at] > 1)[0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Bands:
    """Compression limits by length; chunk_share is the part of a text's bytes that may lie in chunks outside theirs."""

    bands: tuple[tuple[int, float, float], ...] = BANDS
    chunk: int = CHUNK
    chunk_share: float = CHUNK_SHARE
    level: int = LEVEL

    def limits(self, size: int) -> tuple[float, float]:
        return next((low, high) for least, low, high in reversed(self.bands) if size >= least)

    def judge(self, data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, int, int, int, bool]:
        """Ratio of the whole (None without bytes), chunks, bytes of repetitive and of incompressible ones, whether it stays."""
        if not data:
            return None, 0, 0, 0, True
        sides = []
        for piece in (data, *(data[at : at + self.chunk] for at in range(0, len(data), self.chunk))):
            low, high = self.limits(len(piece))
            ratio = len(piece) / len(compressor.compress(piece))
            sides.append((ratio, len(piece) if ratio > high else 0, len(piece) if ratio < low else 0))
        (ratio, high, low), chunks = sides[0], sides[1:]
        repetitive, incompressible = sum(c[1] for c in chunks), sum(c[2] for c in chunks)
        return ratio, len(chunks), repetitive, incompressible, not high and not low and repetitive + incompressible <= self.chunk_share * len(data)


def measure(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    """The values of MEASURES of one text."""
    data = (text or "").encode()
    words = data.split()  # bytes split at exactly the six characters of SPACE
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    ratio, chunks, repetitive, incompressible, stays = bands.judge(data, compressor)
    blanks = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text or "") - blanks, symbols, len(lines) - len(set(lines)), repeated, failed, ratio, chunks, repetitive, incompressible, stays and not failed


def judge(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """docs with MEASURES; `kept` is false where the base rule or a compression band refuses the text."""
    carried = [c for c in docs.columns if c not in _NAMES and c != text]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.int64()] * 3 + [pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [measure(t.as_py(), bands, compressor) for t in texts]
            new = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_NAMES])

    # the text is carried once, last; its type is a string whatever it was before
    given = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").cast("string").alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields) + ", " + MEASURES
    return given.mapInArrow(run, schema)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "bytes_repetitive", "bytes_incompressible")
