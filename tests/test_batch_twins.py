"""Batch methods against plain numpy on whole matrices; axes may differ in sign, so absolute values are compared."""

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import batch as bt

from test_operators import make_frame, rows_of

N, D = 240, 5
BATCH = np.arange(N) % 3
NEG = np.arange(N) % 4 == 0


def power(a, p):
    lam, v = np.linalg.eigh(a)
    return (v * np.maximum(lam, 1e-10) ** p) @ v.T


def top_axes(x, k, scale):
    lam, v = np.linalg.eigh(np.cov(x.T))
    order = lam.argsort()[::-1][:k]
    return v[:, order] / np.sqrt(lam[order]) if scale else v[:, order]


def shrunk(x):
    n, p = x.shape
    c = x - x.mean(0)
    emp = c.T @ c / n
    mu = np.trace(emp) / p
    d2 = ((emp - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - emp) ** 2).sum() for r in c) / n ** 2 / p, d2)
    return b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * emp


def align(z, target=None, eps=0.0, cov=None):
    out = np.empty_like(z)
    for b in range(3):
        fit = z[(BATCH == b) & NEG]
        c = cov(fit) if cov else np.cov(fit.T) + eps * np.eye(z.shape[1])
        m = power(c, -0.5)
        out[BATCH == b] = z[BATCH == b] @ (m if target is None else m @ target)
    return out


def test_original(spark):
    pf, x = make_frame(spark, N, D)
    z = (x - x[NEG].mean(0)) @ top_axes(x[NEG], 3, True)
    got = rows_of(bt.tvn_original(pf, "batch", F.col("negcon"), k=3))
    assert np.allclose(np.abs(got), np.abs(align(z, cov=shrunk)), atol=1e-8)


def test_cascade(spark):
    pf, x = make_frame(spark, N, D)
    z = (x - x[NEG].mean(0)) @ top_axes(x[NEG], 4, True)
    got = rows_of(bt.tvn_cascade(pf, "batch", F.col("negcon"), k1=4, k2=4))
    # The first stage leaves unit covariance, so the second stage only turns the rows: compare lengths.
    assert np.allclose((got ** 2).sum(1), (align(z, cov=shrunk) ** 2).sum(1), atol=1e-6)


def test_aligned(spark):
    pf, x = make_frame(spark, N, D)
    z = (x - x[NEG].mean(0)) / x[NEG].std(0)
    z = (z - z[NEG].mean(0)) @ top_axes(z[NEG], 3, False)
    for b in range(3):
        fit = z[(BATCH == b) & NEG].copy()
        z[BATCH == b] = (z[BATCH == b] - fit.mean(0)) / fit.std(0)
    target = power(np.cov(z[NEG].T) + 0.5 * np.eye(3), 0.5)
    got = rows_of(bt.tvn_aligned(pf, "batch", F.col("negcon"), n_components=3))
    assert np.allclose(np.abs(got), np.abs(align(z, target, 0.5)), atol=1e-8)


def test_tvn(spark):
    pf, x = make_frame(spark, N, D)
    want = np.empty_like(x)
    for b in range(3):
        fit = x[(BATCH == b) & NEG]
        want[BATCH == b] = (x[BATCH == b] - fit.mean(0)) @ power(np.cov(fit.T) + np.eye(D), -0.5)
    assert np.allclose(rows_of(bt.tvn(pf, "batch", F.col("negcon"))), want, atol=1e-8)
