"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language (``sample_chars`` characters, ``total_chars`` over all languages, from rows in
hash order) becomes a suffix automaton. A text is parsed into phrases, each the longest one that occurs in the sample; the
language that needs the fewest phrases, normalised as phrases x log2(sample length) per character, wins. Parsing is a
deterministic automaton (no continuation: the phrase ends and the next begins with this letter), so many stretches of text
step through it side by side. Stretches are ``lane`` characters long, for all languages alike; whole texts are parsed.

Text is lower-cased, letters stay, everything else becomes one blank. Rows: one per input row; `und` with score 0 when a text
is NULL or has no letter, or when nothing was learned. Equal languages: the first name wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.llm import texts as tx

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
SHARPNESS = 12.0


class SuffixAutomaton:
    """States and transitions of all substrings of one sequence of small integers."""

    def __init__(self, line: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in line:
            state = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[state] = q
            last = state

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def parser(self, symbols: int) -> np.ndarray:
        """(state, symbol) -> 2 * next state * symbols + (1 if a phrase began); the last symbol pads. The last state stands
        between phrases: at the beginning, and after a symbol that the sample does not have."""
        between = len(self.next)
        fresh = np.array([2 * self.next[0].get(c, between) * symbols + 1 for c in range(symbols)], dtype=np.int64)
        table = np.tile(fresh, (between + 1, 1))
        for s, moves in enumerate(self.next):
            for c, t in moves.items():
                table[s, c] = 2 * t * symbols
        table[:, symbols - 1] = 2 * symbols * np.arange(between + 1)
        return table.ravel()


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Model:
    """Alphabet, parse tables of all languages end to end, and their sample sizes."""

    def __init__(self, samples: dict[str, str], symbols: int = 64):
        self.is_letter = np.packbits(_letter_table())
        seen: dict[str, int] = {}
        samples = {k: "".join(ch if ch.isalpha() else " " for ch in v.lower()) for k, v in samples.items()}
        for text in samples.values():
            for ch in text:
                if ch != " ":
                    seen[ch] = seen.get(ch, 0) + 1
        common = sorted(seen, key=lambda ch: (-seen[ch], ch))[: symbols - 3]
        self.alphabet = np.array(sorted(map(ord, common)), dtype=np.uint32)  # 0 blank, 1 other letter, 2.. letters, last pads
        self.symbols = len(common) + 3
        self.names = sorted(samples)
        tables, self.base, at = [], [], 0  # base: where each language's last state begins
        self.bits = []
        for name in self.names:
            line = self.symbolic(np.array(list(map(ord, samples[name])), dtype=np.uint32))
            table = SuffixAutomaton(line.tolist()).parser(self.symbols)
            tables.append(table + 2 * at)
            self.base.append(2 * (at + len(table) - self.symbols))
            self.bits.append(np.log2(max(2, len(line))))
            at += len(table)
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)

    def symbolic(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; runs of non-letters are one blank."""
        if not hasattr(self, "_symbol"):
            symbol = np.unpackbits(self.is_letter)[:0x110000].astype(np.uint8)
            symbol[self.alphabet] = np.arange(2, 2 + len(self.alphabet))
            self._symbol = symbol
        line = self._symbol[codes]
        if not len(line):
            return line
        keep = line != 0
        keep[1:] |= line[:-1] != 0
        return line[keep]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_symbol"}

    def costs(self, lines: list[np.ndarray], lane: int) -> np.ndarray:
        """Bits per character for each text and language."""
        n = np.array([len(x) for x in lines])
        pieces = -(-n // lane)
        owner = np.repeat(np.arange(len(lines)), pieces)
        pad = np.full((len(owner), lane), self.symbols - 1, dtype=np.uint8)
        at = 0
        for line, k in zip(lines, pieces.tolist()):
            flat = pad[at:at + k].reshape(-1)
            flat[: len(line)] = line
            at += k
        phrases = np.zeros((len(lines), len(self.names)))
        for lo in range(0, len(owner), 4096):
            block = np.ascontiguousarray(pad[lo:lo + 4096].T).astype(np.int32)
            state = np.repeat(np.array(self.base, dtype=np.int32)[:, None], block.shape[1], axis=1)
            begun = np.zeros(state.shape, dtype=np.int32)
            for column in block:
                got = self.table[(state >> 1) + column]
                flag = got & 1
                begun += flag
                state = got - flag
            for k in range(len(self.names)):
                phrases[:, k] += np.bincount(owner[lo:lo + 4096], weights=begun[k], minlength=len(lines))
        return phrases * np.array(self.bits) / np.maximum(n, 1)[:, None]


def _predict(batches, model: Model, lane: int):
    for batch in batches:
        ids, held = batch.column(0), batch.column(1)
        texts = batch.column(2).to_pylist()
        names, scores = [], []
        for lo, hi in tx.chunked([len(t or "") + 1 for t in texts], 1 << 20):
            lines = [model.symbolic(letters(t or "")) for t in texts[lo:hi]]
            ok = np.array([len(x) > 0 and bool(x.max()) for x in lines])
            if not model.names:
                ok[:] = False
            best, score = np.zeros(len(lines), dtype=np.int64), np.zeros(len(lines))
            if ok.any():
                cost = model.costs([x for x, use in zip(lines, ok) if use], lane)
                best[ok] = cost.argmin(axis=1)
                score[ok] = 1 / np.exp(-SHARPNESS * (cost - cost.min(axis=1)[:, None])).sum(axis=1)
            names += [model.names[b] if use else "und" for b, use in zip(best.tolist(), ok)]
            scores += score.tolist()
        yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def learn(docs: DataFrame, sample_chars: int = 24_000, total_chars: int = 2_400_000) -> Model:
    """The model of a bounded sample: rows in hash order, per language until ``sample_chars`` characters.

    A row counts with at most as many characters as a sample has. Per language they are added up by powers of two of the
    hash, so the smallest power whose rows fill the sample is known before any text is sent; a language with less text gives
    all of it.
    """
    train = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**31)).alias("h"))
    languages = train.select("lang").distinct().count()
    share = max(1, min(sample_chars, total_chars // max(1, languages)))
    bits = F.when(F.col("h") > 0, F.length(F.bin("h"))).otherwise(0)
    weights: dict[str, dict[int, int]] = {}
    for r in train.groupBy("lang", bits.alias("bits")).agg(F.sum(F.least(F.length("text"), F.lit(share))).alias("n")).collect():
        weights.setdefault(r.lang, {})[r.bits] = r.n
    if not weights:
        return Model({})
    wanted = {lang: next((k for k in sorted(n) if sum(m for j, m in n.items() if j <= k) >= share), 31) for lang, n in weights.items()}
    limit = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))
    chosen = train.where(bits <= limit[F.col("lang")]).select("lang", "h", F.substring("text", 1, share).alias("text")).groupBy("lang", "h", "text").agg(F.count("*").alias("copies"))
    samples: dict[str, str] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h, r.text)):
        for _ in range(r.copies):
            have = samples.get(r.lang, "")
            if len(have) >= share:
                break
            samples[r.lang] = have + r.text[: share - len(have)] + "\n"
    return Model(samples)


def identify(docs: DataFrame, sample_chars: int = 24_000, lane: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows of ``docs`` that are not held out."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample_chars))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(it, model.value, lane), SCHEMA)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The whole of documents."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
