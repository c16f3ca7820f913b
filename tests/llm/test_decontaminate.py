"""Contamination against brute force."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phenospark.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(rows, items, window):
    out = Counter()
    for d, t in rows:
        w = words(t)
        hit, named = set(), set()
        for item, text in items:
            q = words(text)
            n = min(len(q), window)
            grams = {tuple(q[i:i + n]) for i in range(len(q) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    named.add(item)
        out[(d, len(w), len(hit), ",".join(sorted(str(x) for x in named if x is not None)))] += 1
    return out


@pytest.mark.parametrize("window,block_bytes", [(10, 16 << 20), (3, 16 << 20), (4, 300)])
def test_documents(spark, documents, corpus, window, block_bytes):
    items = [(i, corpus[3 * i][1][:150 + 10 * i]) for i in range(12)] + [(50, "Alpha"), (51, None), (52, "!!"), (53, "x1 beta"), (None, corpus[60][1]), (2, "zwei drei Été"), (0, corpus[0][1][:150])]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in dc.contamination(documents, frame, window, block_bytes).withColumn("doc_id", dc.tx.public_id(F.col("order_id"))).collect())
    assert got == brute(corpus, items, window)


def test_longest(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two three four, FIVE seven")], "item_id long, text string")
    got = {r.order_id: r.longest_match for r in dc.contamination(docs, items, 3).collect()}
    assert got == {1: 5, 2: 0}
    assert [r.doc_id for r in dc.remove_contaminated(docs, items, 3).collect()] == [2]


def test_empty(spark, documents, empty_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(empty_documents, none).count() == 0
    assert dc.contamination(documents, none).where("n_hit > 0").count() == 0
