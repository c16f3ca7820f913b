"""Public tokenizers in tasks, with remembered pieces.

Both vocabularies split a text by a pattern and encode each piece by itself, so a piece's ids can be remembered. The split
is done here only for texts of plain characters, on which the pattern libraries agree; any other text (and any that could
hold a special token) goes through the tokenizer as a whole. Misses are encoded by the tokenizer in batches.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from tokenizers import Tokenizer

#: ASCII, and composed Latin letters whose lower case is one letter.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]*")
#: Pieces, and stretches between blanks, that a worker remembers; a few hundred bytes each.
REMEMBERED, STRETCHES = 150_000, 200_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str, pattern: str, lower: bool):
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.split = regex.compile(pattern).findall
        self.lower = lower
        self.memory: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if "<|" in t or not PLAIN.fullmatch(t)]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        plain = [i for i, ids in enumerate(out) if ids is None]
        lines = self._by_stretch([texts[i].lower() for i in plain]) if self.lower else self._by_piece([texts[i] for i in plain])
        for i, ids in zip(plain, lines):
            out[i] = ids
        return out

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        return self._joined(self.memory, REMEMBERED, [self.split(t) for t in texts], self._encode_pieces)

    def _joined(self, memory: dict[str, bytes], room: int, lines: list[list[str]], encode) -> list[bytes]:
        """Ids of lines of parts; parts that are not remembered are encoded, and remembered while there is room."""
        missing = [p for p in set().union(*lines) if p not in memory]
        known = len(memory)
        memory.update(zip(missing, encode(missing)))
        get = memory.__getitem__
        out = [b"".join(map(get, line)) for line in lines]
        for p in missing[max(0, room - known):]:
            del memory[p]
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = {}
        blank = [p for p in pieces if p.isspace()]
        found.update(zip(blank, self._whole(blank)))
        solid = [p for p in pieces if not p.isspace()]
        groups = [solid[lo:lo + 500] for lo in range(0, len(solid), 500)]
        for group, lines in zip(groups, self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False)):
            found.update(zip(group, self._apart(group, lines)))
        return [found[p] for p in pieces]

    def _apart(self, group: list[str], encoded) -> list[bytes]:
        """Ids of pieces that were encoded as lines of one text; the line ends are pieces of their own, or dropped."""
        ids, words = np.array(encoded.ids, dtype="<u4"), np.array(encoded.word_ids)
        cuts = np.flatnonzero(np.diff(words)) + 1
        raw, edges = ids.tobytes(), [0, *(4 * cuts).tolist(), 4 * len(ids)]
        parts = [raw[a:b] for a, b in zip(edges[:-1], edges[1:])]
        parts = parts if self.lower else parts[::2]
        n = len(group) if self.lower else 2 * len(group) - 1
        return parts if len(cuts) + 1 == n else self._whole(group)

    def _by_stretch(self, texts: list[str]) -> list[bytes]:
        """For vocabularies that drop blanks: no piece crosses one, so stretches between blanks are remembered as a whole."""
        return self._joined(self.stretches, STRETCHES, [t.split() for t in texts], self._by_piece)


#: How the two vocabularies split text.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """The task's encoder for a vocabulary file; kept by the worker process between tasks."""
    if name not in _encoders:
        word = name.startswith("word_")
        _encoders[name] = PieceEncoder(name, WORD_SPLIT if word else BYTE_SPLIT, lower=word)
    return _encoders[name]
