"""SentencePiece BPE, encoded by a table of last tokens and decoded from ids.

Merging is deterministic, so each prefix of a text has one encoding, and an encoding cut at a token's end is the encoding of that
prefix. It is therefore enough to store each prefix's last token. A token that ends at a place (an Aho-Corasick automaton
of all pieces finds them) is the last one exactly if it follows the last token of the prefix before it without a merge across
their border: if the pair of both, merged alone, stays that pair. One pass fills the table, the ids are read off it
backwards. Pairs are tested once and remembered.

Texts are cut first where no piece can cross: before a blank that follows something else (the vocabulary is searched for
pieces that would), and around characters of no piece of several characters. Stretches that recur are remembered with their ids, up to
a bounded number; a table covers one stretch, two bytes a character. Long texts are worked through in blocks.

Only models are taken whose normalizer does nothing but prefix and replace blanks, checked on load. Rows: one per input row, repeated
rows included. NULL texts count as empty and have no ids; the empty text decodes to itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from phenospark.llm import texts as tx
from phenospark.llm.tokens import vocabulary_path

BLANK = "▁"
#: Entries that a worker remembers: stretches of at most 64 characters, and tested pairs.
STRETCHES, LONGEST, PAIRS = 400_000, 64, 400_000
BLOCK_CHARS, BLOCK_IDS = 1 << 19, 1 << 18
#: Stands for a character that is no piece, in tables of last tokens.
LOOSE = 65535
LEAST = float("-inf")
PROBE = " a  b\tc\nd　eﬁ ÁÁ­ x​▁ "


class PieceTable:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n >= LOOSE or not any(map(model.is_byte, range(n))) or model.normalize(PROBE) != BLANK + PROBE.replace(" ", BLANK):
            raise ValueError("a model of fewer than 65,535 pieces, bytes among them, that only replaces blanks is needed")
        pieces = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = pieces
        self.id_of = {pieces[i]: i for i in usual}
        self.score = {pieces[i]: model.get_score(i) for i in usual}
        self.byte_id = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        byte_of = {i: b for b, i in self.byte_id.items()}
        silent = {i for i in range(n) if model.is_control(i)}
        self.spoken = [bytes([byte_of[i]]) if i in byte_of else b"" if i in silent else " ⁇ ".encode() if i == self.unknown else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.decimal = [str(i) for i in range(n)]
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(byte_of)] = True
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        inner = "".join(sorted({c for p in self.id_of if len(p) > 1 for c in p} - {BLANK}))
        crossing = any(BLANK in p.lstrip(BLANK) for p in self.id_of)
        some = f"[{re.escape(inner)}]" if inner else "(?!)"
        self.stretch = re.compile(f"(?:{BLANK}|{some})+|[^{BLANK}{re.escape(inner)}]+" if crossing else f"{BLANK}+{some}*|{some}+|[^{BLANK}{re.escape(inner)}]+")
        self.border = None if crossing else re.compile(f"(?<=[^{BLANK}]){BLANK}")
        self.memory: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.growth: dict[str, list | None] = {}

    # ---- pairs of tokens

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Tokens of a short text, and the merges on the way: (score, first part, last part after it).

        The best-scored adjacent pair that is a piece is merged, the leftmost of equals.
        """
        parts, steps = list(text), []
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                return parts, steps
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            steps.append((best[0], parts[0], parts[-1]))

    def _growth(self, token: str):
        """A token's merges, or None if the token does not come about from its characters."""
        if token not in self.growth:
            parts, steps = self.merged(token)
            self.growth[token] = steps if len(parts) == 1 else None
        return self.growth[token]

    def fit(self, before: str, token: str) -> bool:
        """Whether the two, merged alone, stay two: at no time is a merge across their border the best one."""
        one, two = self._growth(before), self._growth(token)
        if one is None or two is None:
            return False
        x, y, i, j = before[-1], token[0], 0, 0
        while True:
            across = self.score.get(x + y, LEAST)
            left = one[i][0] if i < len(one) else LEAST
            right = two[j][0] if j < len(two) else LEAST
            if left >= across and left >= right and left > LEAST:
                x = one[i][2]
                i += 1
            elif across >= right and across > LEAST:
                return False
            elif right > LEAST:
                y = two[j][1]
                j += 1
            else:
                return True

    # ---- the table

    def last_tokens(self, text: str):
        """For each prefix of the text the id of its last token; LOOSE for a character that is no piece."""
        last = [0] * (len(text) + 1) if len(text) <= LONGEST else array("H", bytes(2 * (len(text) + 1)))
        last[0] = LOOSE
        known = self.fits.get
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            at = end - 1
            while not last[at]:  # places before this one that no token ended at
                last[at] = LOOSE
                at -= 1
            start = end - length
            fits = known(last[start] << 16 | token)
            if fits is None:
                fits = self._test(last[start], token, text[start - 1] if start else "")
            if fits:
                last[end] = token
        at = len(text)
        while not last[at]:
            last[at] = LOOSE
            at -= 1
        return last

    def _test(self, before: int, token: int, char: str) -> bool:
        """``fit`` of two ids, remembered; before a token may be nothing, or a character that is no piece."""
        piece = self.pieces[token]
        if before == LOOSE:
            return self.fit(char, piece) if char else self._growth(piece) is not None
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        fits = self.fits[before << 16 | token] = self.fit(self.pieces[before], piece)
        return fits

    def _stretch_ids(self, text: str) -> bytes:
        last, at, backwards, pieces = self.last_tokens(text), len(text), array("I"), self.pieces
        while at:
            token = last[at]
            if token != LOOSE:
                backwards.append(token)
                at -= len(pieces[token])
            else:
                at -= 1
                backwards.extend([self.byte_id[b] for b in reversed(text[at].encode())])
        backwards.reverse()
        return backwards.tobytes()

    def _known(self, stretch: str) -> bytes:
        found = self.memory.get(stretch)
        if found is None:
            found = self._stretch_ids(stretch)
            if len(stretch) <= LONGEST and len(self.memory) < STRETCHES:
                self.memory[stretch] = found
        return found

    def blocks(self, text: str):
        """The text with its blanks replaced, in parts that no token crosses."""
        if not text:
            return
        whole, lo = BLANK + text.replace(" ", BLANK), 0
        while self.border and len(whole) - lo > BLOCK_CHARS:
            cut = self.border.search(whole, lo + BLOCK_CHARS)
            if not cut:
                break
            yield whole[lo:cut.start()]
            lo = cut.start()
        yield whole[lo:]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        known = self._known
        return b"".join(known(m.group()) if len(block) > BLOCK_CHARS else m for block in self.blocks(text)
                        for m in (self.stretch.finditer(block) if len(block) > BLOCK_CHARS else map(known, self.stretch.findall(block))))

    # ---- and back

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8: bytes that make no character become U+FFFD one by one, the first blank goes."""
        spoken = self.spoken
        out = b"".join(b"".join(map(spoken.__getitem__, ids[lo:lo + BLOCK_IDS].tolist())) for lo in range(0, len(ids), BLOCK_IDS))
        first = len(ids) and self.pieces[ids[0]].startswith(BLANK)
        out = out[1:] if first else out
        try:
            out.decode()
            return out
        except UnicodeDecodeError:
            return self._mended(ids, first)

    def _mended(self, ids: np.ndarray, first: bool) -> bytes:
        """Runs of byte pieces apart from the rest, as bytes of one run alone can make a character."""
        edge = np.flatnonzero(np.diff(np.concatenate(([False], self.is_byte[ids], [False])).astype(np.int8)))
        parts, at = [], 0
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            parts.append(b"".join(self.spoken[i] for i in ids[at:lo].tolist()))
            parts.append(_valid(b"".join(self.spoken[i] for i in ids[lo:hi].tolist())))
            at = hi
        parts.append(b"".join(self.spoken[i] for i in ids[at:].tolist()))
        out = b"".join(parts)
        return out[1:] if first else out

    def ids_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        out = hashlib.sha256()
        for lo in range(0, len(ids), BLOCK_IDS):
            out.update((b"," if lo else b"") + ",".join(map(self.decimal.__getitem__, ids[lo:lo + BLOCK_IDS].tolist())).encode())
        return out.hexdigest()


def _valid(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[at:at + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at:at + n])
            at += n
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_tables: dict[str, PieceTable] = {}


def piece_table(name: str) -> PieceTable:
    """The task's table for a model file; kept by the worker process between tasks."""
    if name not in _tables:
        _tables[name] = PieceTable(vocabulary_path(name))
    return _tables[name]


def _mapped(docs: DataFrame, model: str, fields: list[pa.Field], schema: str, row) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        table = piece_table(model)
        for batch, texts in tx.text_chunks(batches, 4 << 20):
            found = []
            for t in texts:
                ids = np.frombuffer(table.encode(t.decode()), dtype="<u4")
                found.append(row(table, ids))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*found), fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f.name for f in fields)])

    return rows.mapInArrow(run, f"doc_id long, {schema}")


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers) and the text decoded from them, for every row."""
    return _mapped(docs, model, [pa.field("ids", pa.binary()), pa.field("decoded", pa.string())], "ids binary, decoded string",
                   lambda table, ids: (ids.tobytes(), table.decode(ids).decode()))


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The whole of documents: digests of ids and of decoded texts, taken where they are made."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _mapped(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model", fields, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   lambda table, ids: (len(ids), table.ids_digest(ids), hashlib.sha256(table.decode(ids)).hexdigest()))
