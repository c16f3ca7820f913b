"""The table of last tokens against the library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from phenospark.llm import sentencepiece_table as st
from phenospark.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
BITS = [" ", "  ", "▁", "\n", "\r", "\t", "a", "b", "th", "e", "ing", "é", "日本", "😀", "\x00", "�", "ﬁ", "İ", "ß", "мир", "1", "00", ".", "();", "​", "é", "한", "𝒳", "aaaa"]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(MODEL))


@pytest.fixture(scope="module")
def table():
    return st.piece_table(MODEL)


def test_random_texts(table, library):
    rng = random.Random(1)
    for k in range(6000):
        if k % 3 == 0:
            text = "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))
        elif k % 3 == 1:
            text = "".join(table.pieces[rng.randrange(259, 32000)] for _ in range(rng.randrange(12)))
        else:
            text = "".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(20)))
        ids, want = np.frombuffer(table.encode(text), "<u4"), library.encode(text)
        assert ids.tolist() == want and table.decode(ids).decode() == library.decode(want)


def test_pairs_and_any_ids(table, library):
    rng = random.Random(2)
    for k in range(6000):
        a, b = (table.pieces[rng.randrange(259, [32000, 2000][k % 2])] for _ in range(2))
        assert table.fit(a, b) == (table.merged(a + b)[0] == [a, b])
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259), 28705]) for _ in range(rng.randrange(12))]
        assert table.decode(np.array(ids, "<u4")).decode() == library.decode(ids)


def test_long_texts(table, library, monkeypatch):
    texts = ["abcdefghij" * 60_000, "word  and\tmore\n" * 50_000, "é日" * 100_000]
    for text in texts:
        ids = np.frombuffer(table.encode(text), "<u4")
        assert ids.tolist() == library.encode(text) and sha(table.decode(ids)) == sha(text)
    monkeypatch.setattr(st, "BLOCK_CHARS", 50)
    monkeypatch.setattr(st, "BLOCK_IDS", 7)
    ids = np.frombuffer(table.encode(texts[1][:3000]), "<u4")
    want = library.encode(texts[1][:3000])
    assert ids.tolist() == want and table.decode(ids).decode() == library.decode(want)
    assert table.ids_digest(ids) == sha(",".join(map(str, want)))


def test_query(spark, corpus, documents, library, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = st.op11_sentencepiece(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter()
    for d, t in corpus:
        ids = library.encode(t or "")
        want[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_texts_come_back(documents, empty_documents):
    for r in st.encode(documents).collect():
        assert len(r.ids) % 4 == 0 and (r.decoded == "") == (len(r.ids) == 0)
    assert st.encode(empty_documents).count() == 0
