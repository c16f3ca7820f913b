"""Shared helpers: row identity, scratch tables, and numpy work on whole texts inside tasks.

Identity of a row. ``order_id`` is doc_id with NULL last (largest); ``rid`` hashes doc_id and text. Rows that agree in both
are copies of one row and get the same result, so results can be joined back without multiplying repeated rows.

Hashes are polynomials modulo 2^64 over random symbol values, mixed afterwards. They only nominate candidates or name
counters; where a contract needs equality, the text itself is compared later.
"""

from __future__ import annotations

import gc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenospark.session import scratch_path

LAST_ID = 2**63 - 1
BASE = 0x9E3779B97F4A7C15 | 1
MIX_A, MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_tables: dict[str, np.ndarray] = {}


def identified(docs: DataFrame) -> DataFrame:
    """(order_id, rid, text): NULL text becomes empty."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("order_id"),
        F.xxhash64(F.col("doc_id"), F.col("text")).alias("rid"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def public_id(order_id: Column) -> Column:
    """doc_id again: the last id stands for NULL."""
    return F.when(order_id != LAST_ID, order_id)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column; sizes the numbers of buckets, so that a group stays bounded."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts(n_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // per_part))


class Stage:
    """A Parquet table in the shared folder that cuts lineage; ``drop`` removes it when nobody reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        release(self.spark)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see that finished plans are gone, so their shuffle files are deleted now and not some day."""
    gc.collect()
    spark._jvm.System.gc()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "8m"


@contextmanager
def small_batches(spark: SparkSession, size: str = SMALL_BATCH):
    """What runs inside sends Arrow batches of about ``size`` to Python instead of 64 MB, so large rows come a few at a time."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


# ---- inside tasks -------------------------------------------------------------------------------------------------


def _powers(name: str, n: int) -> np.ndarray:
    """base^i or base^-i for i < n."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        step = BASE if name == "up" else pow(BASE, -1, 2**64)
        size = max(n, 1 << 16)
        have = np.full(size, step, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _tables[name] = have
    return have[:n]


def _symbols() -> np.ndarray:
    if "symbols" not in _tables:
        _tables["symbols"] = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
    return _tables["symbols"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the polynomial hash over all bits; in place."""
    h ^= h >> np.uint64(33)
    h *= MIX_A
    h ^= h >> np.uint64(29)
    h *= MIX_B
    h ^= h >> np.uint64(32)
    return h


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers("up", len(values)), out=out[1:])
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for each i; values are uint64 symbols."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    p = _prefix(values)
    return mix((p[k:] - p[:n]) * _powers("down", n))


def byte_gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    return gram_hashes(_symbols()[buf], k)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """Hash of buf[starts[i]:ends[i]]; spans are in order. Works through the buffer in blocks, so memory stays bounded."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + block, side="right")))
        p = _prefix(_symbols()[buf[lo:ends[j - 1]]])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (p[e] - p[s]) * _powers("down", len(p))[s]
        i = j
    return mix(out)


def separator_table(is_separator) -> np.ndarray:
    return np.array([bool(is_separator(b)) for b in range(256)])


#: Words are [^\x20\x09-\x0D]+.
SPACES = separator_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
NOT_ALNUM = separator_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Words:
    """Words of many texts: one buffer, with word starts and ends, and the range of words of each text."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, lower: bool = False):
        joined = b"\n" + b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sep = separators[self.buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        self.first = np.searchsorted(self.starts, np.append(self.text_starts, len(self.buf)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value of each window of w values; the leftmost of equal upper halves."""
    if len(h) < w:
        return np.zeros(0, dtype=np.int64)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if w > span:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span:])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1])
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(values) - 1]))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean per position: inside one of the spans [start, end)."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(ends, n), -1)
    return np.cumsum(step[:-1]) > 0


def chunked(sizes, limit: int):
    """Index ranges whose sizes add up to about limit; one larger item stands alone."""
    lo, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def byte_rows(column: pa.Array) -> list[bytes]:
    """A string column as bytes, NULL as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(batches, limit: int = 2 << 20, column: str = "text"):
    """Arrow batches cut into pieces of about ``limit`` bytes of text: (record batch, texts as bytes)."""
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(rows), 0).to_pylist()
        for lo, hi in chunked(sizes, limit):
            yield batch.slice(lo, hi - lo), byte_rows(rows.slice(lo, hi - lo))
