"""Vector links against brute force."""

import math
from collections import Counter

import numpy as np
import pytest

from phenospark.llm import embedding_dedup as ed


def brute(rows, threshold):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, dtype=np.float64) / math.sqrt(sum(float(x) ** 2 for x in v)) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    least = list(ids)
    while True:
        new = [min([least[i]] + [least[j] for j in near[i]]) for i in range(n)]
        if new == least:
            break
        least = new
    return Counter((rows[i][0], len(near[i]), None if least[i] == 2**63 - 1 else least[i], ids[i] == least[i]) for i in range(n))


@pytest.mark.parametrize("block,k", [(512, 10), (16, 3)])
def test_links(spark, block, k):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 8))
    x = np.concatenate((centers[rng.integers(0, 12, 150)] + 0.12 * rng.standard_normal((150, 8)), rng.standard_normal((80, 8)))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, [2 * v for v in rows[0][1]]), (401, None), (402, []), (403, [0.0] * 8), (404, [1.0, None] * 4), (405, [float("nan")] * 8), (406, [float("inf")] + [0.0] * 7), (407, [1.0, 2.0]), (408, [1.0, 2.1]), (None, rows[5][1]), (None, None), (5, rows[5][1]), (409, [1e-30] * 8), (410, [1.0] * 8)]
    frame = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = Counter(tuple(r) for r in ed.near_vectors(frame, block=block, k=k, leaf=8).collect())
    want = brute([(d, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for d, v in rows], 0.95)
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ed.near_vectors(none).count() == 0
    assert [tuple(r) for r in ed.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]
