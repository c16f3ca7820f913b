"""Token counts and packing against the tokenizers themselves."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from phenospark.llm import packing, token_counts, tokens

EXTRA = [(400, "x <|endoftext|> y<|startoftext|>"), (401, "İstanbul ΑΣ naïve ﬁ é   a b"), (402, "don't I'LL we've 12345 ½ ² a\x1cb \x85 tab\t\ttab\r\n  x   "), (403, "é" * 9000 + " word" * 9000)]


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus + EXTRA


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int").repartition(3)


def test_counts(frame, rows, tmp_path):
    k = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    want = Counter((d, len((t or "").encode()), len(k.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    path = str(tmp_path / "cache")
    for _ in range(2):  # empty cache, then full
        assert Counter(tuple(r) for r in token_counts.count_tokens(frame, path).collect()) == want
    stored = frame.sparkSession.read.parquet(path)
    assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for _, t in rows})


@pytest.mark.parametrize("group_tokens,most", [(4_000_000, 64), (20_000, 4)])
def test_packing(frame, rows, group_tokens, most):
    k = Tokenizer.from_file(tokens.vocabulary_path("word_bpe_49k.json"))
    got = packing.pack(frame, group_tokens=group_tokens, most_open=most, merge_pieces=30, with_ids=True).collect()
    want = Counter((d, tuple(k.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    spans = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens, r.start].append(tuple(np.frombuffer(r.ids, dtype="<u4").tolist()))
    assert sum(len(x) for x in by_doc.values()) == sum(-(-len(ids) // 4096) * n for (_, ids), n in want.items())
    pieces = Counter((d, p) for (d, _, _), ps in by_doc.items() for p in ps)
    assert pieces == sum((Counter({(d, ids[a:a + 4096]): n}) for (d, ids), n in want.items() for a in range(0, len(ids), 4096)), Counter())
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(spans) <= total / 4096 * 1.1 + 2


def test_empty(empty_documents, tmp_path):
    assert packing.pack(empty_documents).count() == 0
    assert token_counts.count_tokens(empty_documents, str(tmp_path / "cache")).count() == 0
