"""Substring dedup by repeated-phrase automata.

A word goes when it is covered by a window of ``width`` words whose word sequence also starts in a document with a smaller
doc_id. Recurring passages are confirmed on their words: windows that always follow one another are one passage, named by
its first window. Those are the phrases of Aho-Corasick automata (one per bounded block of a shard), and the segments of all
documents stream through the automaton of their shard, which locates every occurrence of every passage; its length and the
smallest doc_id that has it come with it.

Rows: one per input row. NULL or blank text has no words. NULL doc_id counts as larger than any. Repeated rows (same id) are
one document: they do not remove each other's words.
"""

from __future__ import annotations

from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import repeats, texts as tx


class WordUnit:
    """Windows of words; a segment is its words joined by one space."""

    between_texts = True

    def __init__(self, width: int = 13, gram: int = 7, block: int = 1 << 18):
        self.width, self.gram, self.block = width, min(gram, width), block

    def anchors(self, texts: list[bytes]):
        """Runs of windows with one anchor: (text, first start, last start, anchor place, view, anchor hash), in blocks of windows."""
        words = tx.Words([b" ".join(t.split()) for t in texts])
        h, owner = words.hashes(), words.text_of_words()
        view = _WordView(words, self.width)
        last = words.first[1:][owner] - self.width if len(owner) else owner
        for lo in range(0, len(h), self.block):
            part = h[lo:lo + self.block + self.width - 1]
            grams = tx.gram_hashes(part, self.gram)
            at = tx.window_argmin(grams, self.width - self.gram + 1)
            starts = np.arange(len(at))
            ok = lo + starts <= last[lo:lo + len(at)]
            at, starts = at[ok], starts[ok]
            if not len(at):
                continue
            a, b = tx.runs_of(at * (len(texts) + 1) + owner[lo + starts])
            first_word = words.first[owner[lo + starts[a]]]
            yield owner[lo + starts[a]], lo + starts[a] - first_word, lo + starts[b] - first_word, lo + at[a] - first_word, view, grams[at[a]]


class _WordView:
    def __init__(self, words: tx.Words, width: int):
        self.words, self.width, self.raw = words, width, words.buf.tobytes()

    def segments(self, text: int, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        w, raw, base = self.words, self.raw, self.words.first[text]
        return [raw[a:b] for a, b in zip(w.starts[base + first].tolist(), w.ends[base + last + self.width - 1].tolist())]

    def stretch(self, text: int, first: int, end: int) -> bytes:
        w, base = self.words, self.words.first[text]
        return self.raw[w.starts[base + first]:w.ends[base + end - 1]]


def _ranked(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the words are: up to seven bytes by their bytes and length, longer ones by a dict."""
    size = ends - starts
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))[starts].astype(np.uint64)
    unused = (8 * (8 - np.minimum(size, 7))).astype(np.uint64)
    codes = (eight >> unused << unused) | size.astype(np.uint64) & np.uint64(0xFF)
    long = np.flatnonzero(size > 7)
    raw, ids = buf.tobytes(), {}
    codes[long] = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(starts[long].tolist(), ends[long].tolist())], dtype=np.uint64) << np.uint64(8) | np.uint64(8)
    return _ranked(codes)


def _names(codes: np.ndarray, offsets: list[int]) -> np.ndarray:
    """A number for each place, equal where the codes at all offsets from it are equal; ranked again before it overflows."""
    n = max(0, len(codes) - offsets[-1])
    base = int(codes.max(initial=0)) + 1
    names, bound = np.zeros(n, dtype=np.int64), 1
    for i in offsets:
        if bound * base >= 2**63:
            names = _ranked(names)
            bound = int(names.max(initial=0)) + 1
        names = names * base + codes[i:i + n]
        bound *= base
    return names


class _Lines:
    """The words of a block's segments as symbols for an automaton.

    A symbol names several consecutive words, and a window is up to three symbols, ``step`` words apart, that cover it. A
    segment is streamed as ``step`` strands, each with every step-th symbol, so that a window's symbols are neighbours.
    """

    def __init__(self, segments: list[bytes], width: int):
        buf = np.frombuffer(b" ".join(segments), dtype=np.uint8)
        ends = np.append(np.flatnonzero(buf == 0x20), len(buf))
        starts = np.append(0, ends[:-1] + 1)
        codes = _word_codes(buf, starts, ends)
        size = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(s) + 1 for s in segments])))
        self.step, self.most = (width // 3, 3) if width > 2 else (1, 1)
        span = width - self.step * (self.most - 1)
        self.owner = np.repeat(np.arange(len(segments)), size)
        self.begin = np.cumsum(size) - size
        left = np.repeat(self.begin + size, size) - np.arange(len(codes))  # words from here to the segment's end
        self.windows = np.flatnonzero(left >= width)
        self.symbols = _ranked(_names(codes, list(range(span))))
        self.window_names = _names(self.symbols, [i * self.step for i in range(self.most)])[self.windows]
        place = np.flatnonzero(left >= span)
        strand = self.owner[place] * self.step + (place - self.begin[self.owner[place]]) % self.step
        self.place = place[np.argsort(strand, kind="stable")]

    def passages(self, by: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each different window the windows in the passage it begins, 0 if it lies inside one.

        ``by`` orders the windows so that equal ones are the runs lo..hi. A window lies inside a passage if it and one other
        window always come right after one another; so finding a passage's first window finds all of it.
        """
        name = np.empty(len(by), dtype=np.int64)
        name[by] = np.repeat(np.arange(len(lo)), hi - lo + 1)
        joins = (np.diff(self.windows) == 1) & (np.diff(self.owner[self.windows]) == 0)
        before, after = np.append(-1, np.where(joins, name[:-1], -1))[by], np.append(np.where(joins, name[1:], -1), -1)[by]
        always = [np.where(np.minimum.reduceat(x, lo) == np.maximum.reduceat(x, lo), x[lo], -1) for x in (before, after)]
        inside = (always[0] >= 0) & (always[1][always[0]] == np.arange(len(lo)))
        heads = np.flatnonzero(~inside[name])
        length = np.zeros(len(lo), dtype=np.int64)
        length[name[heads]] = np.diff(np.append(heads, len(name)))
        return length

    def phrases(self, at: np.ndarray):
        """The symbols of the windows that start at the given words."""
        return zip(*(self.symbols[at + i * self.step].tolist() for i in range(self.most)))

    def located(self, automaton, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each occurrence of a phrase (``at``: where each is found once), and the phrase's value, in order of the start."""
        symbols = self.symbols[self.place]
        used = np.zeros(len(self.symbols), dtype=bool)
        used[self.symbols[at + self.step * np.arange(self.most)[:, None]]] = True
        used = used[symbols]
        used[1:] |= used[:-1]  # of symbols that no phrase has, the first of each run: the others leave the automaton at its root too
        place = self.place[used]
        hits = np.fromiter(chain.from_iterable(automaton.iter(tuple(symbols[used].tolist()))), dtype=np.int64).reshape(-1, 2)
        hits = hits[hits[:, 0] >= self.most - 1]
        first, last = place[hits[:, 0] - self.most + 1], place[hits[:, 0]]
        ok = (last - first == self.step * (self.most - 1)) & (self.owner[first] == self.owner[last])  # not across strands
        by = np.argsort(first[ok], kind="stable")
        return first[ok][by], hits[ok, 1][by]


def _locate(width: int, block_bytes: int):
    def decide(table: pa.Table) -> pa.Table:
        anchors, sids, found = [], [], []
        for block in repeats.blocks_of_keys(table, block_bytes):
            segments = block.column("segment").to_pylist()
            first, last = block.column("first").to_numpy(), block.column("last").to_numpy()
            lines = _Lines(segments, width)
            by = np.argsort(lines.window_names)
            lo, hi = tx.runs_of(lines.window_names[by])
            if not len(lo):
                continue
            own = lines.owner[lines.windows[by]]
            least, most = np.minimum.reduceat(first[own], lo), np.maximum.reduceat(last[own], lo)
            length = lines.passages(by, lo, hi)
            phrase = np.flatnonzero((least < most) & (length > 0))  # a passage's documents are those of its first window
            if not len(phrase):
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            at = lines.windows[by[lo[phrase]]]
            for symbols, which in zip(lines.phrases(at), phrase.tolist()):
                automaton.add_word(symbols, which)
            automaton.make_automaton()
            start, which = lines.located(automaton, at)
            ok = least[which] < last[lines.owner[start]]
            start, which = start[ok], which[ok]
            if not len(start):
                continue
            own, a, end = lines.owner[start], least[which], start + length[which]
            new = np.ones(len(start), dtype=bool)  # a run: adjoining passages of a segment with one smallest document
            new[1:] = (own[1:] != own[:-1]) | (a[1:] != a[:-1]) | (start[1:] != end[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(start)) - 1
            runs = np.stack((start[lo] - lines.begin[own[lo]], end[hi] - 1 - lines.begin[own[lo]], a[lo]), axis=1).astype(np.int64)
            names = block.column("anchor").to_numpy()
            for x, y in zip(*tx.runs_of(own[lo])):
                line = own[lo[x]]
                anchors.append(int(names[line]))
                sids.append(repeats.segment_id(segments[line]))
                found.append(runs[x:y + 1].tobytes())
        return repeats.flag_table(anchors, sids, found)

    return decide


def _strip(batches, width: int):
    for batch, texts in tx.text_chunks(batches):
        order = batch.column(batch.schema.get_field_index("order_id")).to_pylist()
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        out = {k: [] for k in ("order_id", "n_words", "n_removed", "kept")}
        for own, got, text in zip(order, spans, texts):
            words, gone = text.split(), 0
            n = len(words)
            if got:
                hits = np.concatenate([np.frombuffer(s["found"], dtype=np.int64).reshape(-1, 3) + (s["start"], s["start"], 0) for s in got])
                hits = hits[hits[:, 2] < own]
                if len(hits):
                    stays = ~tx.covered(n, hits[:, 0], hits[:, 1] + width)
                    words = list(compress(words, stays.tolist()))
                    gone = n - len(words)
            out["order_id"].append(own)
            out["n_words"].append(n)
            out["n_removed"].append(gone)
            out["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items()], names=list(out))


def remove_repeated_phrases(docs: DataFrame, width: int = 13, hot: int = 20_000, huge: int = 200_000, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) for every row of ``docs``."""
    spans, _ = repeats.repeated_windows(docs, WordUnit(width), _locate(width, block_bytes), hot=hot, huge=huge)
    joined = tx.identified(docs).join(spans, ["order_id", "rid"], "left")
    kept = joined.select("order_id", "text", "spans").mapInArrow(lambda it: _strip(it, width), "order_id long, n_words long, n_removed long, kept string")
    return kept.select(tx.public_id(F.col("order_id")).alias("doc_id"), "n_words", "n_removed", "kept")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole of documents with windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_phrases(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
