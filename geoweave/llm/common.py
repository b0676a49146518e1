"""Shared helpers: scratch tables in the cluster's shared folder, Arrow text buffers, vectorised byte hashing.

Every function here works on one Arrow batch or builds a lazy plan; nothing collects a corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.session import ensure_checkpoint_dir

U64 = np.uint64
#: Odd multiplier of the polynomial byte hash (2^64 / golden ratio).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in slices of about this many bytes, so memory does not follow batch or text size.
SLICE_BYTES = 2_000_000
#: Documents in one Arrow batch between the JVM and Python.
ROWS_PER_BATCH = 1000

_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: lineage ends here, and
    a lost executor costs only its own tasks.  Snappy keeps no native buffers between files, unlike zstd."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(spark: SparkSession) -> int:
    """Number of partitions that the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text: str = "text") -> Column:
    """64-bit fingerprint of a text (null counts as empty); with ``doc_id`` it identifies a row's content."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, kept between calls."""
    known = _powers.setdefault(base, np.ones(1, U64))
    while len(known) < n:
        known = np.concatenate([known, known * U64(pow(base, len(known), 1 << 64))])
    _powers[base] = known
    return known[:n]


class ByteHash:
    """Hashes of any byte range of a buffer in constant time (prefix sums of a polynomial)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=self.total[1:])
        self.scale = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw hashes of ``data[start:end]``; equal bytes at different places give equal values."""
        return (self.total[end] - self.total[start]) * self.scale[start]

    def rolling(self, width: int) -> np.ndarray:
        """Raw hash of every window of ``width`` bytes."""
        return (self.total[width:] - self.total[:-width]) * self.scale[: len(self.total) - width]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's first and last+1 byte; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type)
                         else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = at[:-1], at[1:]
    if column.null_count:
        end = np.where(np.asarray(column.is_null()), start, end)
    return buf, start, end


def slices(start: np.ndarray, end: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose texts hold about ``size`` bytes (one text may be longer)."""
    total = np.cumsum(end - start)
    i, n = 0, len(start)
    while i < n:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + size, "right")))
        yield i, j
        i = j


def word_table(separators: str, keep: str = "") -> np.ndarray:
    """Byte map of a word rule: 0 separates words, other bytes are kept with A-Z lower-cased.

    ``separators``: the separating characters, or with ``keep`` given, every ASCII character not in it.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    if keep:
        for b in range(128):
            if chr(b).lower() not in keep:
                table[b] = 0
    for c in separators:
        table[ord(c)] = 0
    return table


def words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive rows as (hash, row, first byte, last+1 byte); a word never spans two rows.

    Texts longer than a slice are cut at a separator, so prefix sums stay small.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for row_from, row_to in slices(start, end):
        lo, hi = int(start[row_from]), int(end[row_to - 1])
        while lo < hi:
            cut = hi
            if hi - lo > 2 * SLICE_BYTES:  # one long text: cut after a separator
                cut = lo + SLICE_BYTES
                while cut < hi and table[buf[cut - 1]]:
                    more = np.flatnonzero(table[buf[cut: cut + 65536]] == 0)
                    cut = min(hi, cut + (int(more[0]) + 1 if len(more) else 65536))
            part = table[buf[lo:cut]]
            inner = part != 0
            edge = np.zeros(len(part) + 1, bool)
            at = start[row_from:row_to] - lo
            edge[at[(at >= 0) & (at <= len(part))]] = True
            first = inner.copy()
            first[1:] &= ~inner[:-1] | edge[1:-1]
            last = inner.copy()
            last[:-1] &= ~inner[1:] | edge[1:-1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            raw = ByteHash(part).of(s, e)
            rows = row_from + np.searchsorted(start[row_from:row_to], s + lo, "right") - 1
            out.append((mix(raw + (e - s).astype(U64)), rows, s + lo, e + lo))
            lo = cut
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
