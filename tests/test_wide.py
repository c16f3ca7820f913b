"""Tiles, leading axes and permuted copies against numpy; results must not depend on tiles, blocks or partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import axes as ax
from phenospark.operators import batch as bt
from phenospark.operators import linalg as la
from phenospark.operators.frame import ProfileFrame


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return rng.normal(size=(400, 70)) @ np.diag(np.r_[np.linspace(9, 3, 10), np.ones(60)]) @ np.linalg.qr(rng.normal(size=(70, 70)))[0] + 50


def frame(spark, x, n_parts=4):
    rows = [(i, "abc"[i % 3] if i % 10 else None, i % 4 == 0 and i % 3 != 1, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, batch string, negcon boolean, features array<double>").repartition(n_parts)
    return ProfileFrame(df, tuple(f"f{i}" for i in range(x.shape[1])))


def test_tiles(spark, data):
    shift = np.full(70, 49.0)
    found = la.moment_tiles(frame(spark, data), ["batch"], None, shift, tile=32).collect()
    assert max(len(r.g) for r in found) <= 32 * 32 and len(found) == 4 * 6
    for key in ("a", "b", "c", None):
        own = np.array([("abc"[i % 3] if i % 10 else None) == key for i in range(400)])
        m = la.Moments.of([(r.i, r.j, r.n, r.s, r.g) for r in found if r.batch == key], 70, shift, 32)
        x = data[own]
        assert m.n == own.sum() and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov(), np.cov(x.T))


def test_leading_axes(spark, data):
    lam, v = np.linalg.eigh(np.cov(data.T))
    lam, v = lam[::-1], v[:, ::-1]
    for k in (1, 7, 70):
        found = ax.principal_axes(frame(spark, data), k, None, tile=32, exact_width=0)
        assert np.allclose(found.variances, lam[:k], rtol=1e-8) and np.isclose(found.total, lam.sum()) and found.n == 400
        assert np.allclose(found.axes @ found.axes.T, v[:, :k] @ v[:, :k].T, atol=1e-6)
    share = ax.principal_axes(frame(spark, data), 0.8, None, tile=32, exact_width=0)
    whole = ax.principal_axes(frame(spark, data), 0.8)
    assert len(share.variances) == len(whole.variances) == int(np.searchsorted(np.cumsum(lam) / lam.sum(), 0.8)) + 1
    assert np.allclose(share.axes @ share.axes.T, whole.axes @ whole.axes.T, atol=1e-6)


def test_few_rows_and_low_rank(spark):
    rng = np.random.default_rng(1)
    x = np.outer(rng.normal(size=30), rng.normal(size=64))
    found = ax.principal_axes(frame(spark, x), 3, None, tile=16, exact_width=0)
    assert np.isclose(found.ratio[0], 1.0) and np.allclose(found.variances[1:], 0, atol=1e-8)


def test_models_of_several_rows(spark, data, monkeypatch):
    import pyarrow as pa

    pf = frame(spark, data)
    models = bt.batch_models(pf, "batch", F.col("negcon"), lambda m: (m.mean, la.matrix_power(m.cov() + np.eye(70), -0.5)))
    want = {r.row_id: r.features for r in la.apply_models(pf, models, "batch", pf.names).df.collect()}
    assert not np.allclose(want[3], data[3]) and np.allclose(want[1], data[1])
    monkeypatch.setattr(la, "MODEL_ROW_BYTES", 8 * 70 * 20)
    rows = [r for m in models.collect() for b in la.model_rows(m.batch, pa.string(), "batch", np.array(m.mu), np.reshape(m.m, (70, 70))) for r in b.to_pylist()]
    assert len(rows) == 4 * models.count()
    cut = spark.createDataFrame([(r["batch"], r["part"], r["mu"], r["m"]) for r in rows], models.schema).repartition(3)
    for size in (1 << 30, 0):
        got = la.apply_models(pf, cut, "batch", pf.names, broadcast_bytes=size).df.collect()
        assert len(got) == 400 and all(np.allclose(r.features, want[r.row_id]) for r in got)


def test_permuted_ranks():
    for n in (1, 2, 3, 10, 1000, 4097):
        for key in (0, 1, 12345678901):
            assert sorted(bt.permuted_ranks(np.arange(n), np.uint64(n), np.uint64(key)).tolist()) == list(range(n))
    a = np.array([bt.permuted_ranks(np.arange(200), np.uint64(200), np.uint64(k)) for k in range(400)])
    assert abs(a[:, 0].mean() - 99.5) < 10 and abs(np.corrcoef(a[:, 0], a[:, 1])[0, 1]) < 0.2


def test_envelope_is_the_same_for_all_blocks_and_partitions(spark, data):
    x = data[:, :6]
    found = []
    for parts, cells in ((1, 1 << 21), (7, 60), (3, 600)):
        out = bt.parallel_envelope(frame(spark, x, parts), None, "ZCA-cor", 3, 5, block_cells=cells).first()
        found.append(out["random_max"])
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])
    want = np.zeros(6)
    for p in range(3):
        y = np.empty_like(x)
        for j, key in enumerate(bt._mixed(np.arange(6, dtype=np.uint64) + np.uint64((5 << 32) + (p << 20)))):
            y[bt.permuted_ranks(np.arange(400), np.uint64(400), key), j] = x[:, j]
        want = np.maximum(want, np.linalg.svd((y - y.mean(0)) / y.std(0), compute_uv=False))
    assert np.allclose(found[0], want)


@pytest.mark.parametrize("remove,extra", [("threshold", {"variance": 0.6}), ("mp", {}), ("pa", {"n_permutations": 3})])
def test_removal_per_batch(spark, data, remove, extra):
    x = data[:, :8].copy()
    x[:, 1] = np.where(np.arange(400) % 3 == 0, x[:, 0], x[:, 1])
    pf = frame(spark, x)
    pf = pf.with_df(pf.df.filter("batch is not null"))
    out = bt.spherize(pf, "batch", F.col("negcon"), "ZCA-cor", remove=remove, **extra)
    rows = out.df.collect()
    tops = {r.key: r.random_max for r in bt.parallel_envelope(pf, F.col("negcon"), "ZCA-cor", 3, 0, "batch", True).collect()}
    for key in "abc":
        at = np.array([i for i in range(400) if i % 10 and "abc"[i % 3] == key])
        fit = at[(at % 4 == 0) & (at % 3 != 1)] if key != "b" else at
        z = (x[at] - x[fit].mean(0)) / x[fit].std(0)
        s, v = np.linalg.svd((x[fit] - x[fit].mean(0)) / x[fit].std(0), full_matrices=False)[1:]
        power = s ** 2
        k = {"threshold": min(int(np.searchsorted(np.cumsum(power) / power.sum(), 0.6)) + 1, 7),
             "mp": int((power / (len(fit) - 1) > (1 + np.sqrt(8 / len(fit))) ** 2).sum()),
             "pa": int(np.argmax(s <= tops[key]))}[remove]
        want = np.square(z @ v[k:].T).sum(1) if k else None
        for i, r in ((i, r) for r in rows for i in [np.searchsorted(at, r.row_id)] if r.batch == key):
            assert len(r.features) == out.width
            if k:
                kept = [q for q in r.features if q is not None]
                assert r.n_kept == len(kept) == 8 - k and np.isclose(np.square(kept).sum(), want[i])


@pytest.mark.parametrize("labelled", [False, True])
def test_thresholds_travel_once_and_references_stream_past_them(spark, labelled):
    from phenospark.operators import pairs as pr

    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(1900, 3)), 1)
    rows = [(i, "k" if i < 1800 else "l", v.tolist(), [str(i % 3), f"b{i % 7}"], sorted(int(t) for t in rng.integers(-4_000_000, 4_000_000, 1 + i % 4))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, key string, features array<double>, marks array<string>, thr array<bigint>")
    labels = "marks" if labelled else None
    q, r = pr.side(df.filter("id % 2 = 0"), "id", ["key"], labels=labels, thresholds="thr"), pr.side(df, "id", ["key"], labels=labels)
    assert pr._tiles(q, r, 16, above=True).filter("_tag = 0").count() == 950
    steps = np.rint(x @ x.T / 1e-6)
    for with_steps in (True, False):
        got = {g._id: g._list for g in pr.count_above(q, r, 3, block=16, exclude_shared_labels=labelled, steps=with_steps).collect()}
        assert len(got) == 950
        for i, key, _, marks, thr in rows[::2]:
            ok = np.array([k == key and j != i and not (labelled and set(m) & set(marks)) for j, k, _, m, _ in rows])
            want = [int((steps[i][ok] > t).sum()) for t in thr]
            assert [g.above if with_steps else g for g in got[i]] == want


def test_undefined_similarities_keep_thresholds_ascending(spark):
    from phenospark.operators import evaluate as ev

    df = spark.createDataFrame([([-2 ** 63, 5],), ([3, 5],), ([],)], "s array<bigint>")
    low = -2 ** 62
    assert [r[0] for r in df.select(ev.ascending_thresholds(F.col("s"))).collect()] == [[-2 ** 63, low, 5], [low, 3, 5], [low]]
