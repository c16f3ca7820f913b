"""Fingerprints, trie join and components against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phenospark.llm import components, simhash as sh


def brute_fp(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, budget):
    fps = np.array(fps, dtype=np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= budget
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_documents(documents, corpus):
    got = Counter((r.doc_id, r.fp, r.component_id) for r in sh.near_duplicates(documents, block=16).select(sh.tx.public_id(F.col("order_id")).alias("doc_id"), "fp", sh.tx.public_id(F.col("component_id")).alias("component_id")).collect())
    fps = [brute_fp(t) for _, t in corpus]
    label = brute_groups(fps, 4)
    ids = [2**63 - 1 if d is None else d for d, _ in corpus]
    least = {g: min(i for i, x in zip(ids, label) if x == g) for g in set(label.tolist())}
    want = Counter((d, int(np.uint64(f).astype(np.int64)), None if least[g] == 2**63 - 1 else least[g]) for (d, _), f, g in zip(corpus, fps, label))
    assert got == want


@pytest.mark.parametrize("budget,block", [(4, 64), (4, 10_000), (0, 32), (9, 100)])
def test_trie_join(spark, budget, block):
    rng = np.random.default_rng(budget)
    fps = rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)
    near = fps[rng.integers(0, 300, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 12, 400).astype(np.uint64)) ^ rng.integers(0, 64, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, near, dense, [np.uint64(0), np.uint64(2**64 - 1)])))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got, _ = sh.fingerprint_groups(df, budget, block)
    roots = {r.fp: r.root for r in got.collect()}
    roots = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    label = brute_groups(fps, budget)
    assert len(set(zip(roots, label.tolist()))) == len(set(roots)) == len(set(label.tolist()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 560)] + [(900, 900), (700, 701), (701, 700)]
    got, _ = components.connected_components(spark.createDataFrame(chain, "src long, dst long"))
    got = {r.node: r.component for r in got.collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in range(500, 560)) and got[701] == 700


def test_empty(empty_documents):
    assert sh.near_duplicates(empty_documents).count() == 0
