"""Substring and suffix-array dedup against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.llm import substring_dedup as sub, suffix_dedup as suf

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, width):
    first = {}
    for d, t in rows:
        w = SEP.findall(t or "")
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = Counter()
    for d, t in rows:
        w = SEP.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            f = first.get(tuple(w[i:i + width]))
            if f is not None and (d is None or f < d):
                gone[i:i + width] = [True] * width
        out[(d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


def brute_bytes(rows, width):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = 1
        out[(d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("width,hot,huge", [(13, 20_000, 200_000), (13, 3, 10**9), (13, 3, 20), (2, 2, 5)])
def test_words(documents, corpus, width, hot, huge):
    got = Counter(tuple(r) for r in sub.remove_repeated_phrases(documents, width=width, hot=hot, huge=huge).collect())
    assert got == brute_words(corpus, width)


@pytest.mark.parametrize("width,hot,huge", [(200, 20_000, 200_000), (200, 3, 10**9), (200, 3, 20), (40, 3, 10**9)])
def test_bytes(documents, corpus, width, hot, huge):
    rows = suf.strip_repeated_bytes(documents, width=width, hot=hot, huge=huge).withColumn("doc_id", suf.tx.public_id(F.col("order_id")))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows.collect())
    assert got == brute_bytes(corpus, width)


def test_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 300), (2, "aé" + "é" * 200)], "doc_id long, text string")
    for r in suf.strip_repeated_bytes(docs, whole_characters=True).collect():
        bytes(r.kept).decode()


def test_empty(empty_documents):
    assert sub.remove_repeated_phrases(empty_documents).count() == 0
    assert suf.strip_repeated_bytes(empty_documents).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice([97, 98], 300).astype(np.uint8)) * 3
    for width in (8, 20, 60):
        order, same = suf.suffix_order(text, np.arange(len(text) - width + 1), width)
        strings = [text[p:p + width] for p in order.tolist()]
        assert strings == sorted(strings)
        assert same.tolist() == [False] + [a == b for a, b in zip(strings[:-1], strings[1:])]
