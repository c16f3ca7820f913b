"""Merkle manifest against a plain tree of lists."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenospark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, payload int, row string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings_of(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 16
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 16])))
        i //= 16
    return out


def plain(rows):
    by_source = defaultdict(list)
    for d, text, lang, source, n, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        change = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        first = plain_leaf(d, source, lang, n, text)
        by_source[source].append(((d is not None, d or 0), first, d, plain_leaf(d, source, lang, n, low) if change else first))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[1] for x in sorted(by_source[s])]) for s in order}
    upper = levels_of([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, (_, first, d, changed) in enumerate(sorted(by_source[s])):
            path = siblings_of(trees[s], i) + siblings_of(upper, k)
            node = changed
            for left, right in path:
                node = H(left, node, right)
            out[d, first, trees[s][-1][0], upper[-1][0], H(*(a + b for a, b in path)), node, node == upper[-1][0]] += 1
    return out


def result(spark, frame, tmp_path):
    frame.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in got.collect())


def test_against_plain_tree(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "Ab", "ärger ABC", "lower only", "Ω X\x00", "x" * 70])
    row = lambda d, s: (d, text(), rng.choice(["en", None, ""]), s, rng.choice([None, 5, -1]), 1, "q")
    rows = [row(d, "big") for d in rng.sample(range(-3000, 9000), 4500)]
    rows += [row(rng.randrange(-2**63, 2**63), s) for s in ("wide", "") for _ in range(40)]
    rows += [row(i, f"s{i % 23}é") for i in range(60)] + [row(7, "one"), row(1, None), row(2, None), row(16, "exact")]
    rows += [row(i, "exact") for i in range(16)]
    rows += [row(None, "big") for _ in range(20)] + [row(5, "big") for _ in range(60)] + [(9, "Same", "en", "big", 4, 1, "q")] * 40
    rows += [(50, "L" * 300_000, "en", "long", 300_000, 1, "q")]
    assert result(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "Only", "en", "a", 4, 0, "")], [(5, "Only", None, None, 4, 0, "")] * 2])
def test_small(spark, tmp_path, rows):
    assert result(spark, spark.createDataFrame(rows, SCHEMA), tmp_path) == plain(rows)


def test_places_are_whole(spark, documents):
    rows = merkle.manifest(documents).select("source", "index", "total", "leaf", "siblings", "root").withColumn("up", merkle.fold(F.col("leaf"), F.col("siblings"))).collect()
    assert sorted(r["index"] for r in rows) == list(range(rows[0].total)) and all(r.up == r.root for r in rows)
