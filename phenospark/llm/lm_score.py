"""Language-model scores by a weighted backoff automaton.

Model: n-grams of words and an end token, counted over the training documents, each order smoothed towards the next lower
one: p(w | h) = (c(hw) + strength x p(w | shorter h)) / (c(h) + strength), and p(w) = (c + 1) / (N + V + 1). That is a backoff
automaton: states are the histories seen, an arc leaves state h for each w with c(hw) > 0 and weighs log10 p(w | h), and the
failure arc to the shorter history weighs log10 (strength / (c(h) + strength)). A text is one left-to-right traversal.

The counts cover the whole corpus and go to nobody as a whole. Tasks pack the documents that they read into compressed chunks,
written once, so the first pass moves no text. A chunk sends its different n-grams with their numbers (so a frequent n-gram is
one entry per chunk) to buckets, ranges of their hashes; a bucket adds them up, one order at a time, and answers each chunk for
the n-grams it asked about; the chunk then holds the part of the automaton its texts can reach.
Words are named by 56-bit hashes, longer n-grams by as many bits as the corpus needs (its bytes in bits, and 18 more; 48 to
64), so that a name stands for two n-grams about once in 2^18 or less at every size. Names are sent as sorted differences in byte planes, which compress well.

Rows: one per input row. NULL text is empty and still has its end token. Repeated rows are counted each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx
from phenospark.llm.language_id import held_out

START, END, STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D1 | 1)
REQUEST_SCHEMA = "bucket int, size int, chunk long, n int, keys binary, counts binary"
TOTAL_SCHEMA = "chunk long, bucket int, size int, totals binary, n_sum long, n_distinct long"
CHUNK_SCHEMA = "chunk long, docs binary"
SCORE_SCHEMA = "order_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
BATCH_BYTES = 4 << 20


class Grams:
    """Tokens of many texts; ``levels`` gives the hash of the n-gram that ends at each token, order by order."""

    def __init__(self, texts: list[bytes]):
        words = tx.Words(texts, lower=True)
        own = words.text_of_words()
        ends = words.first[1:] + np.arange(len(texts))
        self.tokens = np.empty(len(own) + len(texts), dtype=np.uint64)
        own += np.arange(len(own))
        self.tokens[own] = words.hashes()
        self.tokens[ends] = END
        self.n = np.diff(words.first) + 1
        self.first = ends - self.n + 1

    def levels(self, order: int) -> Iterator[np.ndarray]:
        ends, start = self.tokens, START
        yield ends
        for _ in range(1, order):
            ends = self.before(ends, start)
            ends *= STEP
            ends += self.tokens
            tx.mix(ends)
            start = tx.mix(np.array([start]) * STEP + START)[0]
            yield ends

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value at the token before each token; ``start`` at the first of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the values, all lowest bytes first, as many planes as the largest value needs (first byte), compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(pa.decompress(raw[1:], decompressed_size=width * n, codec="zstd"), dtype=np.uint8).reshape(width, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64)[:, 0]


def _by_bucket(keys: np.ndarray, buckets: int, bits: int):
    """Distinct keys in order, the place of each key among them, and (bucket, from, to): buckets are ranges of keys."""
    distinct, place = np.unique(keys >> np.uint64(64 - bits), return_inverse=True)
    bucket = (distinct >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    lo, hi = tx.runs_of(bucket)
    return distinct, place, [(int(bucket[a]), int(a), int(b) + 1) for a, b in zip(lo, hi)]


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a few megabytes, so that an answer never stands in memory as a whole."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes)) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("docs", pa.binary())])
TOTAL_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("totals", pa.binary()), ("n_sum", pa.int64()), ("n_distinct", pa.int64())])


def _bits(size: int, bits: int) -> int:
    return 56 if size == 1 else bits


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple]:
    """The rows of a task in chunks of about ``chunk_bytes`` of text, compressed; a longer text stands alone."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        for lo, hi in tx.chunked(sizes, chunk_bytes // 8):
            piece = sum(sizes[lo:hi])
            if held and size + piece > chunk_bytes:
                yield task << 32 | made, _compressed(held)
                made, held, size = made + 1, [], 0
            held.append(batch.slice(lo, hi - lo))
            size += piece
    if held:
        yield task << 32 | made, _compressed(held)


def _compressed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(docs: bytes) -> tuple[Grams, pa.Table]:
    """The tokens of a chunk, and its rows without their texts."""
    rows = pa.ipc.open_stream(docs).read_all()
    return Grams([t for part in rows.column("text").chunks for t in tx.byte_rows(part)]), rows.drop_columns("text")


def _requests(chunk: int, docs: bytes, order: int, buckets: int, bits: int) -> Iterator[tuple]:
    """Of one chunk: its different n-grams of each order and how often its training rows have them."""
    grams, rows = _unpacked(docs)
    held = rows.column("held_out").to_pylist()
    train = np.repeat(~np.array(held, dtype=bool), grams.n)
    for size, ends in enumerate(grams.levels(order), 1):
        keys, place, bounds = _by_bucket(ends, buckets, _bits(size, bits))
        counts = np.bincount(place[train], minlength=len(keys))
        del place
        for bucket, a, b in bounds:
            yield bucket, size, chunk, b - a, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(counts[a:b])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of one bucket and order: the total of each n-gram, told to every chunk in the order in which it asked."""
    chunks, sizes, keys, counts = [], [], [], []
    bucket = size = None
    for batch in batches:
        for bucket, size, chunk, n, gaps, found in zip(*(c.to_pylist() for c in batch.columns)):
            chunks.append(chunk)
            sizes.append(n)
            keys.append(np.cumsum(_unplanes(gaps, n), dtype=np.uint64))
            counts.append(_unplanes(found, n).astype(np.uint32))
    keys = np.concatenate(keys)
    distinct, place = np.unique(keys, return_inverse=True)
    n_distinct = len(distinct)
    del keys, distinct
    total = np.bincount(place, weights=np.concatenate(counts), minlength=n_distinct).astype(np.uint64)
    counts.clear()
    at = 0
    for chunk, n in zip(chunks, sizes):
        yield chunk, bucket, size, _planes(total[place[at:at + n]]), 0, 0
        at += n
    yield -1, bucket, size, b"", int(total.sum()), int((total > 0).sum())


class BackoffAutomaton:
    """The automaton's weights at the tokens of given texts, order by order from the words up.

    At each token the state is the longest history; it takes the arc of the token where the n-gram is known, else its
    failure arc to the next shorter history, whose weight is already known from the order before.
    """

    def __init__(self, n: int, v: int, starts: int, strength: float):
        self.total, self.starts, self.strength = n + v + 1, starts, strength

    def scores(self, grams: Grams, counts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 probability, log10 add-one probability, and whether the token is known. ``counts`` gives
        the training count of the n-gram that ends at each token, order by order."""
        counts = iter(counts)
        seen = next(counts)
        known = seen > 0
        p = (seen + 1) / self.total
        base = np.log10(p)
        score = base.copy()
        for higher in counts:
            history = grams.before(seen, self.starts)
            history += self.strength
            p *= self.strength
            p += higher
            p /= history
            failure = np.log10(self.strength / history) + score
            score = np.where(higher > 0, np.log10(p), failure)
            seen = higher
        return score, base, known


def _token_counts(grams: Grams, answers: dict, order: int, buckets: int, bits: int) -> Iterator[np.ndarray]:
    for size, ends in enumerate(grams.levels(order), 1):
        keys, place, bounds = _by_bucket(ends, buckets, _bits(size, bits))
        del keys
        yield np.concatenate([_unplanes(answers.pop((size, bucket)), b - a).astype(np.float64) for bucket, a, b in bounds])[place]


def _score(docs: pa.Table, totals: pa.Table, order: int, buckets: int, bits: int, n: int, v: int, starts: int, strength: float) -> pa.Table:
    names = ["order_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    grams, rows = _unpacked(docs.column("docs")[0].as_py())
    answers = {(s, b): t for s, b, t in zip(*(totals.column(c).to_pylist() for c in ("size", "bucket", "totals")))}
    score, base, known = BackoffAutomaton(n, v, starts, strength).scores(grams, _token_counts(grams, answers, order, buckets, bits))
    sums = [np.add.reduceat(x, grams.first) for x in (known.astype(np.int64), base, score)]
    return pa.table([rows.column("order_id"), rows.column("held_out"), pa.array(grams.n, pa.int64()), *(pa.array(x) for x in sums)], names=names)


def score_texts(docs: DataFrame, order: int = 3, strength: float = 150.0, chunk_bytes: int = 12 << 20) -> DataFrame:
    """order_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; held-out rows
    (crc32 of doc_id modulo 7 is 2) are scored and not learned from."""
    size = tx.text_bytes(docs)
    buckets = tx.parts(size, chunk_bytes)
    bits = min(64, max(48, size.bit_length() + 18))
    order_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(tx.LAST_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(order_id.alias("order_id"), text.alias("text")).withColumn("held_out", held_out(tx.public_id(F.col("order_id")), 7))
    starts = rows.where("not held_out").count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_pack(batches, chunk_bytes), CHUNK_ARROW)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        return _batches((asked for chunk, packed in chunks for asked in _requests(chunk, packed, order, buckets, bits)), REQUEST_ARROW)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_add_up(batches), TOTAL_ARROW)

    chunks = tx.Stage(rows.mapInArrow(pack, CHUNK_SCHEMA), "chunks").df
    asked = chunks.mapInArrow(ask, REQUEST_SCHEMA)
    totals = tx.Stage(asked.groupBy("bucket", "size").applyInArrow(answer, TOTAL_SCHEMA), "totals")
    sums = totals.df.where("chunk = -1 and size = 1").agg(F.sum("n_sum"), F.sum("n_distinct")).first()
    n, v = sums[0] or 0, sums[1] or 0
    tx.release(docs.sparkSession)  # the requests' plan is known to be over only now
    told = totals.df.where("chunk >= 0").select("chunk", "bucket", "size", "totals")
    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda d, t: _score(d, t, order, buckets, bits, n, v, starts, strength), SCORE_SCHEMA)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """The whole of documents."""
    scored = score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select(tx.public_id(F.col("order_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
