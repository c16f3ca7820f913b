"""Suffix-array dedup with deep-shallow sorting.

A byte goes when it is covered by a string of ``width`` bytes that also starts anywhere else, in the same document too. The
suffixes of a shard's segments are sorted: a multikey sort (eight bytes per key) down to a shallow depth, then a blind trie
orders each group that still shares that prefix. Neighbours in the suffix array with a common prefix of ``width`` bytes, or
one segment that occurs more than once, are the repeated strings.

Rows: one per input row. NULL text is empty. Matches never cross documents. Copies of a row repeat each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import repeats, texts as tx


class ByteUnit:
    """Windows of bytes; a segment is the bytes themselves."""

    between_texts = False

    def __init__(self, width: int = 200, gram: int = 24, block: int = 1 << 20):
        self.width, self.gram, self.block = width, min(gram, width), block

    def anchors(self, texts: list[bytes]):
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)))
        begins = ends - np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        for lo in range(0, len(buf), self.block):
            grams = tx.byte_gram_hashes(buf[lo:lo + self.block + self.width - 1], self.gram)
            at = tx.window_argmin(grams, self.width - self.gram + 1)
            starts = np.arange(lo, lo + len(at))
            owner = np.searchsorted(ends, starts, side="right")
            ok = starts + self.width <= ends[owner]
            at, starts, owner = at[ok], starts[ok], owner[ok]
            if not len(at):
                continue
            a, b = tx.runs_of(at * (len(texts) + 1) + owner)
            yield owner[a], starts[a] - begins[owner[a]], starts[b] - begins[owner[a]], lo + at[a] - begins[owner[a]], _ByteView(texts, self.width), grams[at[a]]


class _ByteView:
    def __init__(self, texts: list[bytes], width: int):
        self.texts, self.width = texts, width

    def segments(self, text: int, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        raw = self.texts[text]
        return [raw[a:b] for a, b in zip(first.tolist(), (last + self.width).tolist())]

    def stretch(self, text: int, first: int, end: int) -> bytes:
        return self.texts[text][first:end]


class BlindTrie:
    """Patricia trie that stores branching depths and bytes only; a probe is compared once, with one leaf."""

    __slots__ = ("strings", "numbers", "root")

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.numbers = [int.from_bytes(s, "big") for s in strings]
        self.root: int | tuple = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        new, node = self.strings[i], self.root
        while not isinstance(node, int):
            depth, kids = node
            node = kids.get(new[depth]) if new[depth] in kids else next(iter(kids.values()))
        old = self.strings[node]
        lo = len(new) - ((self.numbers[i] ^ self.numbers[node]).bit_length() + 7) // 8  # longest common prefix
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < lo:
            parent, node = node, node[1][new[node[0]]]
        if not isinstance(node, int) and node[0] == lo:
            node[1][new[lo]] = i
            return
        fresh = (lo, {old[lo]: node, new[lo]: i})
        if parent is None:
            self.root = fresh
        else:
            parent[1][new[parent[0]]] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def blind_order(rests: list[bytes]) -> list[int] | tuple:
    """Order of different strings of one length; a trie of two leaves is one comparison."""
    if len(rests) < 3:
        return (0,) if len(rests) == 1 else (0, 1) if rests[0] < rests[1] else (1, 0)
    return BlindTrie(rests).order()


def suffix_order(text: bytes, positions: np.ndarray, width: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The given positions in the order of their next ``width`` bytes, and whether each equals the one before it there.

    Deep-shallow: multikey sort by eight bytes at a time while groups remain and the depth is below ``shallow``; then each
    remaining group goes through a blind trie over its different rests (equal rests share a leaf).
    """
    n = len(positions)
    same = np.zeros(n, dtype=bool)
    if n < 2:
        return positions, same
    padded = np.frombuffer(text + b"\0" * 8, dtype=np.uint8)
    words = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
    depths = list(range(0, min(shallow, width) - 7, 8))
    order = positions[np.argsort(words[positions].astype(np.uint64), kind="stable")] if depths else positions
    bound = np.zeros(n, dtype=bool)  # a new group starts here
    bound[0] = True
    if depths:
        first = words[order].astype(np.uint64)
        bound[1:] = first[1:] != first[:-1]
    for depth in depths[1:]:
        group = np.cumsum(bound)
        size = np.bincount(group)[group]
        open_ = np.flatnonzero(size > 1)
        if not len(open_):
            break
        key = words[order[open_] + depth].astype(np.uint64)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, own = key[by], group[open_]
        bound[open_[1:]] |= (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    done = 8 * len(depths)
    cuts = np.append(np.flatnonzero(bound), n)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2:
            continue
        leaves: dict[bytes, list[int]] = {}
        for p in order[lo:hi].tolist():
            leaves.setdefault(text[p + done:p + width], []).append(p)
        rests = list(leaves)
        at = lo
        for leaf in blind_order(rests):
            members = leaves[rests[leaf]]
            order[at:at + len(members)] = members
            same[at + 1:at + len(members)] = True
            at += len(members)
    return order, same


def _decide(width: int, block_bytes: int):
    def decide(table: pa.Table) -> pa.Table:
        anchors, sids, found = [], [], []
        for block in repeats.blocks_of_keys(table, block_bytes):
            segments = block.column("segment").to_pylist()
            text = b"".join(segments)
            lengths = np.array([len(s) for s in segments])
            begins = np.cumsum(lengths) - lengths
            windows = lengths - width + 1
            owner = np.repeat(np.arange(len(segments)), windows)
            positions = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
            many = np.array(block.column("n").to_pylist()) > 1
            order, same = suffix_order(text, positions, width)
            twice = same.copy()
            twice[:-1] |= same[1:]
            repeated = np.zeros(len(text) + 1, dtype=bool)
            repeated[order[twice]] = True
            repeated[positions[many[owner]]] = True
            hits = repeated[positions]
            who, offset = owner[hits], (positions - begins[owner])[hits]
            names = block.column("anchor").to_pylist()
            for lo, hi in zip(*tx.runs_of(who)):
                a, b = tx.runs_of(offset[lo:hi + 1] - np.arange(hi - lo + 1))
                anchors.append(names[who[lo]])
                sids.append(repeats.segment_id(segments[who[lo]]))
                found.append(np.stack((offset[lo + a], offset[lo + b]), axis=1).astype(np.int64).tobytes())
        return repeats.flag_table(anchors, sids, found)

    return decide


def removed_spans(spans: list | None, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs [start, end) from the repeated window runs of one document."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hits = np.concatenate([np.frombuffer(s["found"], dtype=np.int64).reshape(-1, 2) + s["start"] for s in spans])
    gone = tx.covered(n, hits[:, 0], hits[:, 1] + width).astype(np.int8)
    step = np.diff(np.concatenate(([0], gone, [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _strip(batches, width: int, whole_characters: bool):
    for batch, texts in tx.text_chunks(batches):
        ids = {k: batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("order_id", "rid", "spans")}
        out = {k: [] for k in ("order_id", "rid", "n_bytes", "n_removed", "n_spans", "kept")}
        for own, rid, spans, raw in zip(ids["order_id"], ids["rid"], ids["spans"], texts):
            starts, ends = removed_spans(spans, len(raw), width)
            cuts = list(zip(starts.tolist(), ends.tolist()))
            if whole_characters:
                cuts = [(_forward(raw, a), _back(raw, b)) for a, b in cuts]
                cuts = [(a, b) for a, b in cuts if a < b]
            edges = [0, *(x for cut in cuts for x in cut), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])) if cuts else raw
            for k, v in zip(out, (own, rid, len(raw), len(raw) - len(kept), len(cuts), kept)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()], names=list(out))


def _forward(raw: bytes, i: int) -> int:
    while i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    return i


def _back(raw: bytes, i: int) -> int:
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


STRIP_SCHEMA = "order_id long, rid long, n_bytes long, n_removed long, n_spans long, kept binary"


def strip_repeated_bytes(docs: DataFrame, width: int = 200, hot: int = 20_000, huge: int = 200_000, block_bytes: int = 2 << 20, whole_characters: bool = False) -> DataFrame:
    """order_id, rid, n_bytes, n_removed, n_spans, kept (bytes) for every row; ``whole_characters`` removes no part of a
    UTF-8 character, so that the rest is a text."""
    spans, _ = repeats.repeated_windows(docs, ByteUnit(width), _decide(width, block_bytes), hot=hot, huge=huge)
    joined = tx.identified(docs).join(spans, ["order_id", "rid"], "left")
    return joined.mapInArrow(lambda it: _strip(it, width, whole_characters), STRIP_SCHEMA)


def _rewrite(batches, width: int):
    for batch, texts in tx.text_chunks(batches):
        spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
        kept = []
        for got, raw in zip(spans, texts):
            cuts = [(_forward(raw, a), _back(raw, b)) for a, b in zip(*(x.tolist() for x in removed_spans(got, len(raw), width)))]
            edges = [0, *(x for cut in cuts if cut[0] < cut[1] for x in cut), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])).decode())
        names = batch.schema.names[:-1]
        at = names.index("text")
        columns = [batch.column(i) for i in range(len(names))]
        nulls = columns[at].is_null().to_pylist()
        columns[at] = pa.array([None if no else k for no, k in zip(nulls, kept)], pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)


def strip_texts(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with texts that lack the repeated strings (whole characters only); n_chars follows if there is one."""
    spans, _ = repeats.repeated_windows(docs, ByteUnit(width), _decide(width, 2 << 20))
    spans = spans.select(F.col("order_id").alias("__order"), F.col("rid").alias("__rid"), F.col("spans").alias("__spans"))
    order, rid = F.coalesce(docs["doc_id"].cast("long"), F.lit(tx.LAST_ID)), F.xxhash64(docs["doc_id"], docs["text"])
    keyed = docs.withColumns({"__order": order, "__rid": rid}).join(spans, ["__order", "__rid"], "left").select(*docs.columns, "__spans")
    out = keyed.mapInArrow(lambda it: _rewrite(it, width), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole of documents with strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return strip_repeated_bytes(docs).select(
        tx.public_id(F.col("order_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
