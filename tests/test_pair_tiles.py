"""Pair tiles that write little: small keys without joins, carried places, counted bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import evaluate as ev
from phenospark.operators import pairs as pr
from phenospark.operators.frame import ProfileFrame


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, None if i % 31 == 0 else i % 23, None if i % 29 == 0 else i % 7, x[i].tolist()) for i in range(len(x))]


@pytest.fixture(scope="module")
def table(spark, data):
    return spark.createDataFrame(data, "row_id long, compound int, plate int, features array<double>")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_small_keys_are_not_joined_with_sizes(table):
    side = pr.side(table, "row_id", ["compound"])
    assert "Join" not in plan(pr._tiles(side, side, 16))
    assert "Join" in plan(pr._tiles(side, side, 2))


def brute(data, positive, negative):
    out = {}
    step = lambda a, b: round(float(np.dot(a[3], b[3])) / 1e-6)
    for q in data:
        pos = [step(q, r) for r in data if positive(q, r)]
        neg = [step(q, r) for r in data if negative(q, r)]
        if pos:
            pos.sort(reverse=True)
            ap = np.mean([(i + 1) / (i + 1 + sum(n > s for n in neg)) for i, s in enumerate(pos)])
            out[q[0]] = (len(pos), len(pos) + len(neg), round(float(ap), 6))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_precision_with_carried_places(table, data, block):
    """Queries without a plate have no negatives and stay."""
    pf = ProfileFrame(table, tuple("abcd"))
    ap = ev.average_precision(pf, ev.PairRule(("compound",)), ev.PairRule(("plate",), ("compound",)), metric="cosine", block=block)
    got = {r.row_id: (r.n_pos_pairs, r.n_total_pairs, round(r.average_precision, 6)) for r in ap.collect()}
    # Codes of NULL compounds are equal, so two rows without one do not meet as negatives.
    want = brute(data, lambda q, r: q[0] != r[0] and q[1] is not None and q[1] == r[1],
                 lambda q, r: q[0] != r[0] and q[2] is not None and q[2] == r[2] and q[1] != r[1])
    assert got == want


@pytest.mark.parametrize("block", [4, 64])
def test_histogram_counted_by_bins(table, data, block, monkeypatch):
    monkeypatch.setattr(pr, "WHOLE_PAIRS", 2_000)
    side = pr.side(table, "row_id", ["plate"])
    got = {r._id: {e.step: e.n for e in r._list} for r in pr.similarity_histogram(side, side, 4, block=block, bins=(2_000_000, 100_000)).collect()}
    for q in data:
        want = {}
        for r in data:
            if q[2] is not None and q[2] == r[2] and q[0] != r[0]:
                bin_ = (round(float(np.dot(q[3], r[3])) / 1e-6) + 2_000_000) // 100_000
                want[bin_] = want.get(bin_, 0) + 1
        assert got.get(q[0], {}) == want
