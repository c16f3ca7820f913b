"""Benchmark decontamination with training suffix arrays.

Documents are the training side, in shards of bounded size. Words of a shard are numbered by the words of the test items
(0: a word no item has); its suffix array holds the suffixes that begin with enough test words to match any window, sorted
by their first ``window`` words. Every test suffix is binary-searched in every shard; the ranges found are the places of its
verbatim matches, and matches that continue each other give the longest ones. Word numbers come from hashes, so each match
is compared with the text afterwards.

Items travel to the tasks in blocks of at most ``block_bytes``; more blocks are more passes, whose matches are merged.

Rows: one per row of ``docs``. NULL text has no words. Items without words never match. Items with a NULL item_id count as
hits but are not listed. Rows with one item_id are one item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx

MATCH_SCHEMA = "order_id long, rid long, n_words long, spans array<long>, items array<string>, longest long"
REPORT_SCHEMA = "order_id long, rid long, n_words long, n_hit long, items array<string>, longest_match long"


class TestItems:
    """Windows of test items: word numbers, item names and the words themselves."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        words = tx.Words([t for _, t in items], tx.NOT_ALNUM, lower=True)
        hashes = words.hashes()
        raw = words.buf.tobytes()
        self.window = window
        self.words = [raw[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())]
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        counts = np.diff(words.first)
        self.names = [name for name, _ in items]
        starts, lengths, owners = [], [], []
        for i, (first, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist())):
            if n:
                own = np.arange(first, first + max(1, n - window + 1))
                starts.append(own)
                lengths.append(np.full(len(own), min(n, window)))
                owners.append(np.full(len(own), i))
        none = [np.zeros(0, np.int64)]
        self.starts, self.lengths, self.owners = (np.concatenate(x or none) for x in (starts, lengths, owners))
        padded = np.concatenate((ids, np.zeros(window, np.int64)))
        inside = np.arange(window)[None, :] < self.lengths[:, None]
        self.low = _keys(np.where(inside, padded[self.starts[:, None] + np.arange(window)], 0))
        self.high = _keys(np.where(inside, padded[self.starts[:, None] + np.arange(window)], 0xFFFFFFFF))
        self.least = int(self.lengths.min()) if len(self.lengths) else 0


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like them."""
    if not len(ids):
        return np.zeros(0, dtype="S1")
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}")[:, 0]


def _number(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def shard_matches(texts: list[bytes], test: TestItems):
    """Words per text, and verified matches as (text, first word, words, item), maximal along the item."""
    words = tx.Words(texts, tx.NOT_ALNUM, lower=True)
    counts = np.diff(words.first)
    if not len(test.starts) or not len(words.starts):
        return counts, []
    ids = _number(words.hashes(), test.vocabulary)
    owner = words.text_of_words()
    line = np.zeros(len(ids) + len(texts) + test.window, dtype=np.int64)  # a 0 after each text
    place = np.arange(len(ids)) + owner
    line[place] = ids
    zeros = np.flatnonzero(line == 0)
    known = zeros[np.searchsorted(zeros, place)] - place  # test words in a row from here
    suffixes = np.flatnonzero((known >= test.least) & (ids > 0))
    if not len(suffixes):
        return counts, []
    keys = _keys(line[place[suffixes][:, None] + np.arange(test.window)])
    order = np.argsort(keys, kind="stable")
    array, keys = suffixes[order], keys[order]
    lo, hi = np.searchsorted(keys, test.low, side="left"), np.searchsorted(keys, test.high, side="right")
    found = np.maximum(hi - lo, 0)
    probe = np.repeat(np.arange(len(found)), found)
    at = array[np.arange(len(probe)) - np.repeat(np.cumsum(found) - found, found) + lo[probe]]
    fits = at + test.lengths[probe] <= words.first[owner[at] + 1]
    probe, at = probe[fits], at[fits]
    if not len(at):
        return counts, []
    by = np.lexsort((at, at - test.starts[probe], test.owners[probe]))
    probe, at = probe[by], at[by]
    line_of = (at - test.starts[probe]) * (len(test.names) + 1) + test.owners[probe]
    cut = np.flatnonzero((line_of[1:] != line_of[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
    raw, matches = words.buf.tobytes(), []
    for a, b in zip(np.concatenate(([0], cut + 1)).tolist(), np.concatenate((cut, [len(at) - 1])).tolist()):
        matches += _verified(words, raw, test, int(at[a]), int(test.starts[probe[a]]), int(at[b] - at[a] + test.lengths[probe[b]]), int(test.lengths[probe[a]]), int(owner[at[a]]), int(test.owners[probe[a]]))
    return counts, matches


def _verified(words, raw, test, p, q, n, width, text, item):
    """The match as it is if all its words are equal; else those of its windows that are."""
    spans = list(zip(words.starts[p:p + n].tolist(), words.ends[p:p + n].tolist()))
    same = [raw[a:b] == w for (a, b), w in zip(spans, test.words[q:q + n])]
    if all(same):
        return [(text, p - int(words.first[text]), n, item)]
    return [(text, p + i - int(words.first[text]), width, item) for i in range(n - width + 1) if all(same[i:i + width])]


def _match_rows(batches, test: TestItems, all_rows: bool):
    for batch, texts in tx.text_chunks(batches):
        order, rid = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("order_id", "rid"))
        counts, matches = shard_matches(texts, test)
        spans, items, longest = {}, {}, {}
        for text, first, n, item in matches:
            spans.setdefault(text, []).extend((first, first + n))
            items.setdefault(text, set()).add(test.names[item])
            longest[text] = max(n, longest.get(text, 0))
        rows = range(len(texts)) if all_rows else sorted(spans)
        yield pa.RecordBatch.from_arrays([
            pa.array([order[i] for i in rows], pa.int64()), pa.array([rid[i] for i in rows], pa.int64()), pa.array([int(counts[i]) for i in rows], pa.int64()),
            pa.array([spans.get(i, []) for i in rows], pa.list_(pa.int64())),
            pa.array([sorted(x for x in items.get(i, ()) if x is not None) for i in rows], pa.list_(pa.string())),
            pa.array([longest.get(i, 0) for i in rows], pa.int64())], names=["order_id", "rid", "n_words", "spans", "items", "longest"])


def _report_rows(batches):
    for batch in batches:
        cols = {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("order_id", "rid", "n_words", "spans", "items", "longest")}
        hit, listed = [], []
        for n, spans, items in zip(cols["n_words"], cols["spans"], cols["items"]):
            edges = np.array(spans or [], dtype=np.int64).reshape(-1, 2)
            hit.append(int(tx.covered(n, edges[:, 0], edges[:, 1]).sum()) if len(edges) else 0)
            listed.append(sorted(set(items or [])))
        yield pa.RecordBatch.from_arrays([
            *(pa.array(cols[k], pa.int64()) for k in ("order_id", "rid", "n_words")), pa.array(hit, pa.int64()), pa.array(listed, pa.list_(pa.string())),
            pa.array([x or 0 for x in cols["longest"]], pa.int64())], names=["order_id", "rid", "n_words", "n_hit", "items", "longest_match"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """order_id, rid, n_words, n_hit, items (item ids), longest_match (words) for every row of ``docs``."""
    test = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = tx.parts(tx.text_bytes(test), block_bytes)
    rows = tx.identified(docs)
    context = docs.sparkSession.sparkContext
    passes = []
    for block in range(blocks):
        part = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        sent = context.broadcast(TestItems([(r.item_id, r.text.encode()) for r in part], window))
        if blocks == 1:
            return rows.mapInArrow(lambda it, sent=sent: _report_rows(_match_rows(it, sent.value, True)), REPORT_SCHEMA)
        passes.append(rows.mapInArrow(lambda it, sent=sent, every=not block: _match_rows(it, sent.value, every), MATCH_SCHEMA))
    more = passes[1]
    for other in passes[2:]:
        more = more.union(other)
    more = more.groupBy("order_id", "rid").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_set("items")).alias("i"), F.max("longest").alias("l"))
    merged = passes[0].join(more, ["order_id", "rid"], "left").select(
        "order_id", "rid", "n_words", F.concat("spans", F.coalesce("s", F.array().cast("array<long>"))).alias("spans"),
        F.concat("items", F.coalesce("i", F.array().cast("array<string>"))).alias("items"), F.greatest("longest", "l").alias("longest"))
    return merged.mapInArrow(_report_rows, REPORT_SCHEMA)


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without a verbatim match, with the columns of ``docs``."""
    hit = contamination(docs, items, window).where("n_hit > 0").select(F.col("order_id").alias("__order"), F.col("rid").alias("__rid")).distinct()
    order = F.coalesce(docs["doc_id"].cast("long"), F.lit(tx.LAST_ID))
    return docs.join(hit, (order == hit["__order"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == hit["__rid"]), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The whole of documents against the whole of benchmark, windows of 10 words."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        tx.public_id(F.col("order_id")).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match")
