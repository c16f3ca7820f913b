"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``passage`` bytes. Each passage is encoded: histograms of its byte classes and of class
pairs (square roots, so that distances are those between distributions), their concentration and the share of words that
repeat the one before, shrunk towards the average for short passages; then a learned layer. Gated
attention gives each passage a weight, and the weighted mean of the encodings is scored. Weights and encoder are learned
from document labels alone.

Learning takes a bounded sample: at most about ``sample_docs`` labelled rows in hash order, and of those at most
``sample_passages`` passages (whole documents until the bound). Scoring passes over whole texts of all rows.

Rows: one per input row; NULL and empty texts are one empty passage. Rows with several labels teach the smallest. If the
sample has no label of one kind, scores are the share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx
from phenospark.llm.language_id import held_out

CLASSES = 48
PAIRS = 256
WIDTH = CLASSES + PAIRS + 8
#: A passage of this many bytes counts half against the average passage.
HALF = 48


def _byte_classes() -> np.ndarray:
    """a-z by letter, A-Z, digits, blank, line ends, two kinds of high bytes, and punctuation over the rest."""
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        if 0x61 <= b <= 0x7A:
            table[b] = b - 0x61
        elif 0x41 <= b <= 0x5A:
            table[b] = 26
        elif 0x30 <= b <= 0x39:
            table[b] = 27
        elif b == 0x20:
            table[b] = 28
        elif 0x09 <= b <= 0x0D:
            table[b] = 29
        elif b >= 0xC0:
            table[b] = 30
        elif b >= 0x80:
            table[b] = 31
        else:
            table[b] = 32 + b % 16
    return table


BYTE_CLASS = _byte_classes()
_pair = (np.arange(CLASSES)[:, None] * 73 + np.arange(CLASSES)[None, :] * 151 + (np.arange(CLASSES)[:, None] * np.arange(CLASSES)[None, :]) * 7) % PAIRS
PAIR_CLASS = _pair.ravel()


def passages(texts: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (the last column: how far to trust them, by length), and the number of passages of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.maximum(1, -(-lengths // passage))
    total = int(counts.sum())
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    first = np.cumsum(counts) - counts
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    which = first[owner] + (np.arange(len(buf)) - begins[owner]) // passage
    kind = BYTE_CLASS[buf]
    single = np.bincount(which * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
    same = which[1:] == which[:-1]
    pair = PAIR_CLASS[kind[:-1] * CLASSES + kind[1:]]
    double = np.bincount(which[:-1][same] * PAIRS + pair[same], minlength=total * PAIRS).reshape(total, PAIRS)
    n = np.maximum(1, single.sum(axis=1, keepdims=True))
    p, q = single / n, double / np.maximum(1, double.sum(axis=1, keepdims=True))
    entropy = lambda x: -(x * np.log(np.maximum(x, 1e-9))).sum(axis=1)
    words = p[:, 28] + p[:, 29]
    line = tx.Words(texts)
    h, own = line.hashes(), line.text_of_words()
    at = first[own] + (line.starts - line.text_starts[own]) // passage
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    n_words = np.bincount(at, minlength=total)
    repeats = np.bincount(at, weights=again, minlength=total) / np.maximum(1, n_words)
    extra = np.stack((repeats, np.sqrt(repeats), entropy(p) / 3, entropy(q) / 4, 4 * (q * q).sum(axis=1), np.minimum(1, words * 3), np.log1p(n[:, 0]) / np.log1p(passage), p[:, 32:].sum(axis=1)), axis=1)
    trust = n / (n + HALF)
    return np.concatenate((np.sqrt(p), np.sqrt(q), extra, trust), axis=1).astype(np.float32), counts


class AttentionModel:
    """tanh encoder, gated attention (tanh x sigmoid), logistic score; learned by Adam on documents."""

    def __init__(self, hidden: int = 24, gate: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": normal(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate), "w": normal(gate, 1), "c": normal(hidden, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale, self.constant = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), None

    def _forward(self, x, counts):
        p, first = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts, axis=0))
        a = e / np.repeat(np.add.reduceat(e, first), counts, axis=0)
        z = np.add.reduceat(a * h, first)
        return h, t, g, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])[:, 0]))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self._forward(self._standard(x), counts)[-1].astype(np.float64)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        """Deviations from the average passage, smaller for short ones."""
        return (x[:, :-1] - self.mean) / self.scale * x[:, -1:]

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> "AttentionModel":
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 0.05
        x = self._standard(x)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        weight = np.sqrt(weight)  # between the classes' shares and equal ones
        first = np.cumsum(counts) - counts
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        rng, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                step += 1
                pick = order[lo:lo + batch]
                own = counts[pick]
                rows = np.repeat(first[pick] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                grads = self._gradients(x[rows], own, y[pick], weight[pick])
                lr = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m = moments[k]
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    self.p[k] = (self.p[k] - lr * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x, counts, y, weight):
        p, first = self.p, np.cumsum(counts) - counts
        h, t, g, a, z, s = self._forward(x, counts)
        out = ((s - y) * weight / len(y))[:, None].astype(np.float32)
        dz = np.repeat(out @ p["c"].T, counts, axis=0)
        da = (dz * h).sum(axis=1, keepdims=True)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), counts, axis=0))
        dtg = de @ p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum(axis=0)}


def _encode(batches, passage: int):
    """(label, passage count, features) of sampled rows."""
    for batch, texts in tx.text_chunks(batches, 1 << 19):
        x, counts = passages(texts, passage)
        ends = np.cumsum(counts)
        rows = [x[b - n:b].tobytes() for b, n in zip(ends, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("h")), batch.column(batch.schema.get_field_index("quality")), pa.array(counts, pa.int64()), pa.array(rows, pa.binary())], names=["h", "quality", "n", "x"])


def learn(docs: DataFrame, labels: DataFrame, passage: int = 1024, sample_docs: int = 6000, sample_passages: int = 30_000) -> AttentionModel:
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    n = known.count()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) / float(2**31)
    chosen = known.where(unit < min(1.0, sample_docs / max(1, n)))
    text = docs.where(unit < min(1.0, sample_docs / max(1, n))).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(chosen, "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text")
    size = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("text") / passage)))).first()[0] or 0
    share = F.pmod(F.xxhash64("h"), F.lit(2**31)) / float(2**31)
    got = rows.where(share < min(1.0, sample_passages / max(1, size))).mapInArrow(lambda it: _encode(it, passage), "h long, quality int, n long, x binary").collect()
    got.sort(key=lambda r: (r.h, r.quality))
    x = np.concatenate([np.frombuffer(r.x, dtype=np.float32).reshape(-1, WIDTH + 1) for r in got]) if got else np.zeros((0, WIDTH + 1), np.float32)
    return AttentionModel().fit(x, np.array([r.n for r in got], dtype=np.int64), np.array([r.quality for r in got], dtype=np.float64))


def _score(batches, model: AttentionModel, passage: int):
    for batch, texts in tx.text_chunks(batches, 1 << 19):
        x, counts = passages(texts, passage)
        scores = model.score(x, counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, passage: int = 1024, model: AttentionModel | None = None) -> DataFrame:
    """doc_id, held_out, score for every row of ``docs``; without a model one is learned from the rows not held out."""
    model = model or learn(docs, labels, passage)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, sent.value, passage), "doc_id long, held_out boolean, score double")


def _keep(batches, model: AttentionModel, passage: int, least: float):
    for batch, texts in tx.text_chunks(batches, 1 << 19):
        x, counts = passages(texts, passage)
        yield batch.filter(pa.array(model.score(x, counts) >= least))


def keep_good(docs: DataFrame, labels: DataFrame, passage: int = 1024, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with the columns of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, passage))
    return docs.mapInArrow(lambda it: _keep(it, sent.value, passage, least), docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The whole of documents; labels from labels.quality."""
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
