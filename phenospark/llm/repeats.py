"""Candidates for repeated windows, found without comparing texts: the part that substring and suffix-array dedup share.

A window is ``width`` consecutive units (words or bytes) of one text. Its anchor is the ``gram`` units inside it with the
smallest hash. The anchor depends on nothing but the window's content, so equal windows have equal anchors at the same
place. Consecutive windows mostly share an anchor; such a run is a segment.

1. Tasks send the anchors' hashes to buckets by hash, as packed arrays (one row per task flush and bucket), 32 bits of each:
   a bucket has few enough that others rarely agree by chance, which would only nominate a segment too many. A bucket tells
   each text which of its anchors occur elsewhere as well.
2. Texts with such anchors send their segments on; a task sends the text of equal segments once, with their number and
   smallest and largest document, so a hot passage or a large group of copies is one row per task. Anchors with over ``hot`` occurrences are cut by
   distance to the anchor and keyed by what those windows share; with over ``huge``, window by window, keyed by the window
   itself. So no key can gather an unbounded number of different segments.
3. A shard (a bounded number of keys) holds all segments of its keys and decides with the operator's own index. Since all
   occurrences of a window meet in one shard, the answer is exact.
4. The answers go back to the texts by segment and then by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx

ANCHOR_SCHEMA = "bucket int, rids binary, counts binary, hashes binary"
REPLY_SCHEMA = "rid long, bucket int, anchors binary, hot binary, huge binary"
SEGMENT_SCHEMA = "anchor long, sid long, order_id long, rid long, start long, segment binary, n long, first long, last long"
FLAG_SCHEMA = "anchor long, sid long, found binary"
FLUSH = 2_000_000
FLUSH_BYTES, FLUSH_SEGMENTS = 24 << 20, 250_000
CELL = 16


def _ids(batch, name) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as its bucket and 32 bits more."""
    return h % np.uint64(buckets << 32)


def _anchor_rows(batches, unit, buckets):
    """Anchor hashes per text, cut by bucket."""
    hashes, owner, rid, base = [], [], [], 0

    def flush():
        h, o, rids = _short(np.concatenate(hashes), buckets), np.concatenate(owner), np.concatenate(rid)
        bucket = (h >> np.uint64(32)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        h, o, bucket = h[by].astype(np.uint32), o[by], bucket[by]
        rows = {k: [] for k in ("bucket", "rids", "counts", "hashes")}
        for lo, hi in zip(*tx.runs_of(bucket)):
            own_lo, own_hi = tx.runs_of(o[lo:hi + 1])
            for k, v in zip(rows, (int(bucket[lo]), rids[o[lo + own_lo]].tobytes(), (own_hi - own_lo + 1).astype(np.int32).tobytes(), h[lo:hi + 1].tobytes())):
                rows[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(v, pa.binary()) for k, v in rows.items() if k != "bucket")], names=list(rows))

    for batch, texts in tx.text_chunks(batches):
        for which, _, _, _, _, h in unit.anchors(texts):
            hashes.append(h)
            owner.append(base + which)
        rid.append(_ids(batch, "rid"))
        base += len(texts)
        if sum(map(len, hashes)) >= FLUSH:
            yield flush()
            hashes, owner, rid, base = [], [], [], 0
    if hashes and sum(map(len, hashes)):
        yield flush()


def _packed(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each of n owners, as bytes; owners are in order."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _recurring(table: pa.Table, unit, hot: int, huge: int) -> pa.Table:
    """Of one bucket: per text the anchors that occur elsewhere, and those with over ``hot`` and ``huge`` occurrences."""
    cols = {n: np.concatenate([np.frombuffer(b, dtype=t) for b in table.column(n).to_pylist()]) for n, t in (("rids", np.int64), ("counts", np.int32), ("hashes", np.uint32))}
    h, who = cols["hashes"], np.repeat(cols["rids"], cols["counts"])
    by = np.lexsort((who, h))
    h, who = h[by], who[by]
    lo, hi = tx.runs_of(h)
    size = hi - lo + 1
    recurs = who[lo] != who[hi] if unit.between_texts else size > 1
    keep, count = np.repeat(recurs, size), np.repeat(size, size)
    h, who, count = h[keep], who[keep], count[keep]
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who, count = h[once], who[once], count[once]
    by = np.argsort(who, kind="stable")
    h, who, count = h[by], who[by], count[by]
    lo, hi = tx.runs_of(who)
    owner = np.repeat(np.arange(len(lo)), hi - lo + 1)
    packed = [_packed(h[count > least], owner[count > least], len(lo)) for least in (0, hot, huge)]
    return pa.table([pa.array(who[lo], pa.int64()), pa.array(np.full(len(lo), table.column("bucket")[0].as_py(), dtype=np.int32)), *packed], names=["rid", "bucket", "anchors", "hot", "huge"])


def _known(rows: list, name: str) -> np.ndarray:
    """A text's anchors as sorted short hashes, from the replies of its buckets."""
    return np.unique(np.concatenate([(np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r[name], dtype=np.uint32).astype(np.uint64) for r in rows]))


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


class _SegmentRows:
    """Rows of one flush: every occurrence, and with the first one of each segment its text and totals."""

    def __init__(self):
        self.cols = {k: [] for k in ("anchor", "sid", "order_id", "rid", "start")}
        self.seen: dict[tuple[int, bytes], list] = {}
        self.bytes = 0

    def add(self, anchor: int, segment: bytes, order_id: int, rid: int, start: int) -> None:
        got = self.seen.get((anchor, segment))
        if got is None:
            sid = segment_id(segment)
            self.seen[anchor, segment] = [len(self.cols["sid"]), 1, order_id, order_id, sid]
            self.bytes += len(segment)
        else:
            sid = got[4]
            got[1] += 1
            if order_id < got[2]:
                got[2] = order_id
            elif order_id > got[3]:
                got[3] = order_id
        for k, v in zip(self.cols.values(), (anchor, sid, order_id, rid, start)):
            k.append(v)

    def batches(self, rows: int = 20_000):
        n = len(self.cols["sid"])
        more = {k: [None] * n for k in ("segment", "n", "first", "last")}
        for (_, segment), (at, count, first, last, _) in self.seen.items():
            for k, v in zip(more.values(), (segment, count, first, last)):
                k[at] = v
        batch = pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in self.cols.values()), pa.array(more["segment"], pa.binary()), *(pa.array(more[k], pa.int64()) for k in ("n", "first", "last"))], names=[*self.cols, *more])
        for lo in range(0, n, rows):
            yield batch.slice(lo, rows)


def _cells(view, unit, text: int, first: int, last: int, place: int, single: bool):
    """A hot anchor's windows, cut by their distance to the anchor into cells of up to 16 (or 1) windows: key, first, last.

    The key names what all windows of a cell share, so equal windows keep meeting.
    """
    most = 1 if single else min(CELL, unit.width - unit.gram + 1)
    for cell in range((place - last) // most, (place - first) // most + 1):
        near, far = place - cell * most, place - cell * most - most + 1  # the cell's last and first start
        core = view.stretch(text, near, far + unit.width) + b"\0%d" % cell
        yield int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True), max(first, far), min(last, near)


def segment_id(segment: bytes) -> int:
    return xxhash.xxh64_intdigest(segment) - 2**63


def _segment_rows(batches, unit, buckets):
    """Segments whose anchor recurs; those of hot anchors in cells."""
    out = _SegmentRows()
    for batch, texts in tx.text_chunks(batches, limit=1 << 20):
        order, rid = _ids(batch, "order_id").tolist(), _ids(batch, "rid").tolist()
        replies = batch.column(batch.schema.get_field_index("replies")).to_pylist()
        known = {k: [_known(rows, k) for rows in replies] for k in ("anchors", "hot", "huge")}
        for which, s0, s1, place, view, h in unit.anchors(texts):
            for lo, hi in zip(*tx.runs_of(which)):
                d = int(which[lo])
                at = lo + np.flatnonzero(_among(_short(h[lo:hi + 1], buckets), known["anchors"][d]))
                hot = _among(_short(h[at], buckets), known["hot"][d])
                for key, start, segment in zip(h[at[~hot]].view(np.int64).tolist(), s0[at[~hot]].tolist(), view.segments(d, s0[at[~hot]], s1[at[~hot]])):
                    out.add(key, segment, order[d], rid[d], start)
                for i, single in zip(at[hot].tolist(), _among(_short(h[at[hot]], buckets), known["huge"][d]).tolist()):
                    for key, first, last in _cells(view, unit, d, int(s0[i]), int(s1[i]), int(place[i]), single):
                        for segment in view.segments(d, np.array([first]), np.array([last])):
                            out.add(key, segment, order[d], rid[d], first)
        if out.bytes > FLUSH_BYTES or len(out.seen) > FLUSH_SEGMENTS:
            yield from out.batches()
            out = _SegmentRows()
    yield from out.batches()


def repeated_windows(docs: DataFrame, unit, decide: Callable[[pa.Table], pa.Table],
                     hot: int = 20_000, huge: int = 200_000, bucket_bytes: int = 64 << 20, shard_bytes: int = 16 << 20) -> tuple[DataFrame, list]:
    """Per text with repeated windows: order_id, rid, spans array<struct<start, found>>; and the tables to drop later.

    ``unit`` cuts texts into windows; ``decide`` gets all distinct segments of a shard as (anchor, segment, n, first, last)
    and answers FLAG_SCHEMA rows: which windows of which segment are repeated.
    """
    spark, size = docs.sparkSession, tx.text_bytes(docs)
    buckets, shards = tx.parts(size, bucket_bytes, 8), tx.parts(size, shard_bytes, 8)
    rows = tx.identified(docs)
    sent = rows.mapInArrow(lambda it: _anchor_rows(it, unit, buckets), ANCHOR_SCHEMA)
    replies = sent.groupBy("bucket").applyInArrow(lambda t: _recurring(t, unit, hot, huge), REPLY_SCHEMA)
    known = tx.Stage(replies.groupBy("rid").agg(F.collect_list(F.struct("bucket", "anchors", "hot", "huge")).alias("replies")), "anchors")
    cut = rows.join(known.df, "rid")
    segments = tx.Stage(cut.mapInArrow(lambda it: _segment_rows(it, unit, buckets), SEGMENT_SCHEMA), "segments")
    known.drop()
    wanted = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = segments.df.where("segment is not null").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(wanted, "shard")
    distinct = shard.groupBy("shard", "anchor", "segment").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    flags = tx.Stage(distinct.groupBy("shard").applyInArrow(lambda t: decide(t.drop(["shard"])), FLAG_SCHEMA), "flags")  # frees the segments' shuffle
    spans = tx.Stage(
        segments.df.select("anchor", "sid", "order_id", "rid", "start").join(flags.df, ["anchor", "sid"])
        .groupBy("order_id", "rid").agg(F.collect_list(F.struct("start", "found")).alias("spans")), "spans")
    segments.drop()
    flags.drop()
    return spans.df, [spans]


def blocks_of_keys(table: pa.Table, limit: int):
    """A shard's rows ordered by key and cut, between keys, into blocks of about ``limit`` bytes of segments."""
    table = table.sort_by("anchor").combine_chunks()
    anchor = table.column("anchor").to_numpy()
    sizes = pc.binary_length(table.column("segment")).to_numpy()
    lo, hi = tx.runs_of(anchor)
    per_key = np.add.reduceat(sizes, lo) if len(lo) else sizes
    for a, b in tx.chunked(per_key.tolist(), limit):
        yield table.slice(lo[a], hi[b - 1] - lo[a] + 1)


def flag_table(anchor: list, sid: list, found: list) -> pa.Table:
    return pa.table([pa.array(anchor, pa.int64()), pa.array(sid, pa.int64()), pa.array(found, pa.binary())], names=["anchor", "sid", "found"])
