"""Leading principal axes of wide tables, from moment tiles and never from a whole d x d matrix.

Tiles are written once. Each pass multiplies the tiles with a block of vectors (d x k, a broadcast of known size) on the
executors; the driver keeps only such blocks. The basis grows by the images of its last block (block Lanczos with full
orthogonalization) and is cut back to the leading directions when it gets wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.operators import linalg as la
from phenospark.operators.frame import ProfileFrame
from phenospark.session import materialize

#: Up to this width, one tile, the whole matrix is decomposed at once.
EXACT_WIDTH = la.TILE


@dataclass(frozen=True)
class Axes:
    """Leading axes as columns, their variances, and what the fit rows have in all."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def ratio(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else self.variances

    def first(self, k: int) -> "Axes":
        return Axes(self.n, self.mean, self.axes[:, :k], self.variances[:k], self.total)

    def whitening(self, epsilon: float = 1e-8) -> np.ndarray:
        """Axes scaled to unit variance."""
        return self.axes / np.sqrt(np.maximum(self.variances, epsilon))


def _signed(axes: np.ndarray) -> np.ndarray:
    """The sign is free: make the largest loading of each axis positive."""
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def _product(tiles: DataFrame, q: np.ndarray, tile: int) -> np.ndarray:
    """X'X q, summed by blocks of rows on the executors."""
    d, k = q.shape
    spans = la.blocks_of(d, tile)
    shared = tiles.sparkSession.sparkContext.broadcast(q)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, j, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), la.row_slices(b.column(2))):
                (a, e), (c, f) = spans[i], spans[j]
                cells = g.reshape(e - a, f - c)
                sums[i] = sums.get(i, 0.0) + cells @ shared.value[c:f]
                if i != j:
                    sums[j] = sums.get(j, 0.0) + cells.T @ shared.value[a:e]
        for i, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([i], pa.int32()), pa.array([1]), la.to_list_array(np.zeros((1, 0))), la.to_list_array(y.reshape(1, -1))],
                                             names=["i", "j", "n", "s", "g"])

    out = np.zeros((d, k))
    summed = la.sum_tiles(tiles.select("i", "j", "g").mapInArrow(parts, la.tile_type(tiles, [])), [])
    for r in summed.select("i", "g").toLocalIterator():
        a, e = spans[r["i"]]
        out[a:e] = np.reshape(r["g"], (e - a, k))
    shared.destroy()
    return out


def leading(tiles: DataFrame, d: int, k: int, shift: np.ndarray, tile: int = la.TILE, tolerance: float = 1e-10, passes: int = 100, seed: int = 0) -> Axes:
    """The k leading axes of the centred data behind materialized tiles."""
    sums, n, trace = np.zeros(d), 0, 0.0
    spans = la.blocks_of(d, tile)
    size = F.sqrt(F.size("g")).cast("int")
    diagonal = F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), lambda r: F.col("g")[r * (size + 1)]), F.lit(0.0), lambda a, x: a + x)
    for r in tiles.where("i = j").select("i", "n", "s", diagonal.alias("trace")).toLocalIterator():
        a, e = spans[r["i"]]
        sums[a:e], n, trace = r["s"], r["n"], trace + r["trace"]
    scatter = lambda q: _product(tiles, q, tile) - np.outer(sums, sums @ q / n)
    k = min(k, d)
    width = min(d, k + max(8, k // 4))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    basis = images = np.zeros((d, 0))
    for _ in range(passes):
        image = scatter(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        h = basis.T @ images
        lam, u = np.linalg.eigh((h + h.T) / 2)
        lead = np.argsort(lam)[::-1][:width]
        lam, v, sv = lam[lead], basis @ u[:, lead], images @ u[:, lead]
        rest = np.linalg.norm(sv[:, :k] - v[:, :k] * lam[:k], axis=0)
        if rest.max(initial=0.0) <= tolerance * max(lam[0], 1e-300):
            break
        if basis.shape[1] + width > max(6 * width, 256):  # cut back to the leading directions
            basis, images = v, sv
        fresh = image
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, s, _ = np.linalg.svd(fresh, full_matrices=False)
        block = left[:, s > 1e-13 * max(lam[0], 1e-300)]
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            break
        block = np.linalg.qr(block)[0]
    return Axes(n, shift + sums / n, _signed(v[:, :k]), np.maximum(lam[:k], 0.0) / (n - 1), (trace - sums @ sums / n) / (n - 1))


def principal_axes(pf: ProfileFrame, k: int | float, where: Column | None = None, tile: int = la.TILE, exact_width: int = EXACT_WIDTH) -> Axes:
    """Leading axes of all rows, or of those under a condition. A float asks for that share of the variance."""
    d = pf.width
    if d <= exact_width:
        m = la.global_moments(pf, where)
        lam, v = np.linalg.eigh(m.cov())
        lam, v = np.maximum(lam[::-1], 0.0), v[:, ::-1]
        found = Axes(m.n, m.mean, _signed(v), lam, float(lam.sum()))
        return found.first(_enough(found, k) if isinstance(k, float) else min(k, d))
    shift = la.column_means(pf, where)
    tiles = materialize(la.moment_tiles(pf, (), where, shift, tile), "tiles")
    if not isinstance(k, float):
        return leading(tiles, d, k, shift, tile)
    asked = 16
    while True:
        found = leading(tiles, d, asked, shift, tile)
        if asked >= d or found.ratio.sum() >= k:
            return found.first(_enough(found, k))
        asked = min(d, 4 * asked)


def _enough(found: Axes, share: float) -> int:
    return min(int(np.searchsorted(np.cumsum(found.ratio), share)) + 1, len(found.variances))
