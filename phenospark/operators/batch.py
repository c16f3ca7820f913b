"""Batch-effect removal: whitening and covariance alignment fitted on controls.

Every method ends as one table of models (batch, mean, matrix), computed from moment sums, and one pass
that applies (x - mean) @ matrix. No rows are gathered to fit: a batch contributes its d x d moments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from phenospark.operators import linalg as la
from phenospark.operators.axes import principal_axes
from phenospark.operators.frame import ProfileFrame, assemble
from phenospark.operators.normalize import standardize
from phenospark.operators.ordered import running_sums
from phenospark.operators.relational import null_safe_join
from phenospark.session import materialize

FEW_CONTROLS = 2


def batch_models(pf: ProfileFrame, batch: str, control: Column | None, fit: Callable[[la.Moments], tuple[np.ndarray, np.ndarray]],
                 min_rows: int = FEW_CONTROLS, fallback_all: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """One (mean, matrix) per batch from the moments of its controls.

    Batches with fewer fit rows than ``min_rows`` get no model, or one from all their rows.
    """
    d, shift = pf.width, la.column_means(pf, control)
    tiles = la.moment_tiles(pf, [batch], control, shift).withColumn("kind", F.lit(0))
    if fallback_all and control is not None:
        tiles = tiles.unionByName(la.moment_tiles(pf, [batch], None, shift).withColumn("kind", F.lit(1)))
    more = [] if extra is None else [c for c in extra.columns if c != batch]
    if extra is not None:
        tiles = tiles.join(extra, batch)
    key_type = to_arrow_type(tiles.schema[batch].dataType)

    def solve(key, m: la.Moments, values: dict):
        if m.n >= min_rows:
            yield from la.model_rows(key, key_type, batch, *(fit(m, SimpleNamespace(**values)) if more else fit(m)))

    models = la.per_key(tiles, batch, d, shift, solve, la.model_type(tiles.schema[batch]), "kind", more)
    return materialize(models, "models")


# ---- spherize ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: out = (x - mean) @ matrix, with what is worth reporting."""

    mean: np.ndarray
    matrix: np.ndarray
    condition: float
    k_removed: int | None = None
    variance_removed: float | None = None

    @property
    def names(self) -> list[str] | None:
        return None if self.k_removed is None else [f"Spherize_{i}" for i in range(self.matrix.shape[1])]


def spherize_fit(m: la.Moments, method: str = "ZCA-cor", epsilon: float = 1e-6, center: bool = True,
                 remove: str | None = None, variance: float | None = None,
                 random_max: np.ndarray | None = None) -> Whitening:
    """Whitening from moments. ``remove`` ('threshold', 'mp', 'pa') instead projects the top axes away."""
    d = len(m.mean)
    mean, scatter, scale = m.mean, m.scatter, np.ones(d)
    if "cor" in method:
        sd = np.sqrt(np.diag(m.scatter) / m.n)
        scale = np.where(sd < 1e-10, 1.0, sd)
        scatter = scatter / np.outer(scale, scale)
    elif not center:
        scatter = scatter + m.n * np.outer(mean, mean)
        mean = np.zeros(d)
    s, v = la.singular_values(la.Moments(m.n, mean, scatter))
    rank, power = len(s), s ** 2
    k = 0
    if remove == "threshold" and variance is not None:
        k = min(int(np.searchsorted(np.cumsum(power) / power.sum(), variance)) + 1, rank - 1)
    elif remove == "mp":
        edge = (1.0 + np.sqrt(d / m.n)) ** 2
        k = min(int((power / (m.n - 1) > edge).sum()), rank - 1)
    elif remove == "pa":
        below = np.flatnonzero(s <= random_max[:rank])
        k = int(below[0]) if len(below) else 0
    condition = float(s[0] / s[-1]) if s[-1] > 0 else float("inf")
    if k > 0:
        return Whitening(mean, v[:, k:] / scale[:, None], condition, k, float(power[:k].sum() / power.sum()))
    w = v / (s + epsilon) * np.sqrt(m.n - 1)
    if "ZCA" in method:
        w = w @ v.T
    elif rank < d:
        padded = np.eye(d)
        padded[:, :rank] = w
        w = padded
    return Whitening(mean, w / scale[:, None], condition)


def spherize(pf: ProfileFrame, batch: str | None = None, control: Column | None = None, method: str = "ZCA-cor",
             epsilon: float = 1e-6, remove: str | None = None, variance: float | None = None,
             n_permutations: int = 10, seed: int = 0) -> ProfileFrame:
    """Whiten per batch or over all rows, fitted on controls when given.

    Axis removal per batch leaves each batch its own number of features: narrower batches end in NULLs, and ``n_kept`` has
    each row's number.
    """
    if batch is None:
        m = la.global_moments(pf, control)
        top = np.array(parallel_envelope(pf, control, method, n_permutations, seed).first()["random_max"]) if remove == "pa" else None
        fitted = spherize_fit(m, method, epsilon, remove=remove, variance=variance, random_max=top)
        return la.apply_matrix(pf, fitted.mean, fitted.matrix, fitted.names or pf.names)
    extra = None
    if remove == "pa":
        extra = parallel_envelope(pf, control, method, n_permutations, seed, batch, fallback_all=True).withColumnRenamed("key", batch)

    def fit(m: la.Moments, row=None):
        w = spherize_fit(m, method, epsilon, remove=remove, variance=variance, random_max=None if row is None else np.array(row.random_max))
        return w.mean, w.matrix

    models = batch_models(pf, batch, control, fit, min_rows=1, fallback_all=True, extra=extra)
    if remove is None:
        return la.apply_models(pf, models, batch, pf.names)
    widths = models.groupBy(batch).agg((F.sum(F.size("m")) / pf.width).cast("int").alias("w"))
    most = widths.agg(F.max("w")).first()[0] or pf.width
    return la.apply_models(pf, models, batch, [f"Spherize_{i}" for i in range(most)], "drop", width_col="n_kept")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted_ranks(rank: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 sends each rank; the three arrays broadcast.

    Six Feistel rounds on the least even number of bits that hold n - 1, repeated until the result is below n.
    """
    rank, n, key = (np.array(x, dtype=np.uint64) for x in np.broadcast_arrays(rank, n, key))
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    at, todo = rank, np.ones(rank.shape, bool)
    while todo.any():
        left, right, h, m, k = at[todo] >> half[todo], at[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for turn in range(6):
            left, right = right, left ^ (_mixed(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) & m)
        at[todo] = (left << h) | right
        todo = at >= n
    return at.astype(np.int64)


def parallel_envelope(pf: ProfileFrame, where: Column | None = None, method: str = "ZCA-cor", n_permutations: int = 10, seed: int = 0,
                      batch: str | None = None, fallback_all: bool = False, block_cells: int = 1 << 21) -> DataFrame:
    """(key, random_max): largest singular values over copies of the data in which each column is permuted on its own.

    Rows are numbered by id within their key (the batch, or all rows); a keyed permutation of the numbers says
    where each value goes, so copies do not depend on partitions or blocks. Values meet by blocks of target rows, and a
    block gives its part of the moments.
    """
    d, id_col = pf.width, pf.id_col
    df = pf.df
    if batch and fallback_all and where is not None:
        counts = df.groupBy(batch).agg(F.count_if(where).alias("_controls"))
        df = null_safe_join(df, counts, [batch]).filter((F.col("_controls") == 0) | where)
    elif where is not None:
        df = df.filter(where)
    shift = la.column_means(pf, where)
    rows = df.select((F.col(batch) if batch else F.lit(0)).alias("key"), F.col(id_col).alias("_id"), "features")
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"))
    numbered = null_safe_join(running_sums(rows, ["key"], ["_id"], {"_rank": F.lit(1)}), sizes, ["key"]).select("key", "_rank", "_n", "features")
    block, spans = max(1, block_cells // d), la.blocks_of(d)
    columns = np.arange(d, dtype=np.uint64)
    moved = T.StructType([T.StructField("key", rows.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("p", "block", "n")),
                          T.StructField("cell", T.ArrayType(T.LongType())), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def send(batches):
        for b in batches:
            for lo in range(0, b.num_rows, max(1, (1 << 20) // d)):
                part = b.slice(lo, max(1, (1 << 20) // d))
                codes = part.column(0).dictionary_encode(null_encoding="encode")
                key_of = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                rank, n = (part.column(i).to_numpy(zero_copy_only=False).astype(np.uint64)[:, None] for i in (1, 2))
                values = (la.to_matrix(part.column(3), d) - shift).ravel()
                for p in range(n_permutations):
                    target = permuted_ranks(rank - np.uint64(1), n, _mixed(columns + np.uint64((seed << 32) + (p << 20))))
                    to = target // block
                    group = key_of[:, None] * (int(to.max()) + 1) + to
                    cell = ((target - to * block) * d + np.arange(d)).ravel()
                    order = np.argsort(group.ravel(), kind="stable")
                    found = group.ravel()[order]
                    edges = np.r_[0, np.flatnonzero(np.diff(found)) + 1, len(found)]
                    at = order[edges[:-1]] // d
                    lists = pa.array(edges.astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at)), pa.array(np.full(len(at), p)), pa.array(to.ravel()[order[edges[:-1]]]), pa.array(n[at, 0].astype(np.int64)),
                         pa.ListArray.from_arrays(lists, pa.array(cell[order])), pa.ListArray.from_arrays(lists, pa.array(values[order]))], names=moved.names)

    tiles_type = T.StructType([T.StructField("key", moved["key"].dataType), T.StructField("p", T.LongType()), *la.tile_type(df, []).fields])
    key_type = to_arrow_type(moved["key"].dataType)

    def meet(table: pa.Table) -> pa.Table:
        size = min(block, table.column("n")[0].as_py() - block * table.column("block")[0].as_py())
        y = np.zeros(size * d)
        for cells, values in zip(table.column("cell").chunks, table.column("value").chunks):
            y[cells.flatten().to_numpy()] = values.flatten().to_numpy()
        y = y.reshape(size, d)
        out = la._TileRows([key_type, pa.int64()], ["key", "p"], limit=1 << 40)
        for i, (a, e) in enumerate(spans):
            for j, (c, f) in enumerate(spans[i:], i):
                out.add((table.column("key")[0].as_py(), table.column("p")[0].as_py()), i, j, size if i == j else 0,
                        y[:, a:e].sum(0) if i == j else np.zeros(0), (y[:, a:e].T @ y[:, c:f]).ravel())
        return pa.Table.from_batches(out.batch())

    tiles = la.sum_tiles(numbered.mapInArrow(send, moved).groupBy("key", "p", "block").applyInArrow(meet, tiles_type), ["key", "p"])
    found_type = T.StructType([T.StructField("copy", T.StructType(tiles_type.fields[:2])), T.StructField("s", T.ArrayType(T.DoubleType()))])
    copy_type = to_arrow_type(found_type["copy"].dataType)

    def values(copy, m: la.Moments, _):
        scatter = m.scatter
        if "cor" in method:
            sd = np.sqrt(np.diag(scatter) / m.n)
            scale = np.where(sd < 1e-10, 1.0, sd)
            scatter = scatter / np.outer(scale, scale)
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(scatter)[::-1], 0.0))
        yield pa.RecordBatch.from_arrays([pa.array([copy], copy_type), la.to_list_array(s[None, :])], names=["copy", "s"])

    found = la.per_key(tiles.select(F.struct("key", "p").alias("copy"), "i", "j", "n", "s", "g"), "copy", d, shift, values, found_type)
    top = found.select("copy.key", F.posexplode("s").alias("idx", "v")).groupBy("key", "idx").agg(F.max("v").alias("random_max"))
    return assemble(top, ["key"], ["random_max"])


# ---- typical variation normalization -----------------------------------------------------------

def tvn(pf: ProfileFrame, batch: str | None, control: Column | None, alpha: float = 0.5, epsilon: float = 1.0) -> ProfileFrame:
    """(x - mean) @ (C + rI)^(-alpha) per batch on its controls; batches with fewer than two stay as they are."""

    def fit(m: la.Moments):
        cov = m.cov()
        cond = la.condition_number(cov)
        r = max(epsilon, cond / 1e8) if cond > la.ILL_CONDITIONED else epsilon
        return m.mean, la.matrix_power(cov + r * np.eye(len(cov)), -alpha)

    if batch is None:
        m = la.global_moments(pf, control)
        if m.n < FEW_CONTROLS:
            m = la.global_moments(pf)
        return la.apply_matrix(pf, *fit(m), pf.names)
    return la.apply_models(pf, batch_models(pf, batch, control, fit), batch, pf.names)


def coral(pf: ProfileFrame, batch: str | None, control: Column, epsilon: float = 0.5) -> ProfileFrame:
    """Whiten each batch by its control covariance and recolour with the covariance of all controls."""
    if batch is None:
        return pf
    target = la.matrix_sqrt(la.global_moments(pf, control).cov() + epsilon * np.eye(pf.width))

    def fit(m: la.Moments):
        return np.zeros(len(m.mean)), la.matrix_inv_sqrt(m.cov() + epsilon * np.eye(len(m.mean))) @ target

    return la.apply_models(pf, batch_models(pf, batch, control, fit), batch, pf.names)


def pca(pf: ProfileFrame, n_components: int | float = 128, whiten: bool = False, control: Column | None = None,
        prefix: str = "PC_", first: int = 1) -> ProfileFrame:
    """Projection on the principal axes of the controls (or of all rows)."""
    found = principal_axes(pf, n_components, control)
    if not isinstance(n_components, float):
        most = min(found.n, pf.width)
        if n_components >= most:
            if most <= 1:
                return pf
            found = found.first(most - 1)
    axes = found.whitening(1e-12) if whiten else found.axes
    return la.apply_matrix(pf, found.mean, axes, [f"{prefix}{i + first}" for i in range(axes.shape[1])])


def control_counts(pf: ProfileFrame, batch: str, control: Column) -> DataFrame:
    return pf.df.groupBy(batch).agg(F.count_if(control).alias("n_controls"))


def clamp_components(wanted: int, min_controls: int, threshold: float = 2.5, action: str = "clamp") -> int:
    """Keep the width usable for covariances from few controls."""
    if min_controls <= 0 or wanted / min_controls <= threshold:
        return wanted
    if action == "abort":
        raise ValueError(f"{wanted} dimensions for {min_controls} controls per batch exceed the ratio {threshold}")
    return min_controls - 1


def smallest_batch(pf: ProfileFrame, batch: str, control: Column) -> int:
    """Fewest controls among batches with at least two."""
    usable = control_counts(pf, batch, control).filter(F.col("n_controls") >= FEW_CONTROLS)
    return usable.agg(F.min("n_controls")).first()[0] or 0


def tvn_aligned(pf: ProfileFrame, batch: str | None, control: Column, n_components: int = 128, epsilon: float = 0.5,
                dim_ratio_threshold: float = 2.5, dim_ratio_action: str = "clamp") -> ProfileFrame:
    """Standardize on controls, PCA on controls, standardize per batch, then align covariances (PC_0...)."""
    scaled = standardize(pf, (), control)
    n_controls = pf.df.filter(control).count()
    fewest = smallest_batch(pf, batch, control) if batch else n_controls
    k = min(n_components, pf.width, n_controls - 1)
    k = clamp_components(k, fewest or n_controls, dim_ratio_threshold, dim_ratio_action)
    found = principal_axes(scaled, k, control)
    reduced = la.apply_matrix(scaled, found.mean, found.axes, [f"PC_{i}" for i in range(found.axes.shape[1])])
    if batch is None:
        return reduced

    def unit(m: la.Moments):
        return m.mean, np.diag(1.0 / (np.sqrt(np.diag(m.scatter) / m.n) + 1e-18))

    centred = la.apply_models(reduced, batch_models(reduced, batch, control, unit), batch, reduced.names)
    return coral(centred, batch, control, epsilon)


def _fourth_moments(pf: ProfileFrame, models: DataFrame, batch: str, control: Column, names) -> DataFrame:
    """Sum of squared squared norms of centred controls per batch (for the shrinkage weight)."""
    centred = la.apply_models(pf.with_df(pf.df.filter(control)), models, batch, names, missing="drop")
    sq = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return centred.df.groupBy(batch).agg(F.sum(sq * sq).alias("fourth"))


def _shrunk_alignment(pf: ProfileFrame, batch: str, control: Column, few: str) -> ProfileFrame:
    """Multiply each batch by the inverse root of its shrunk control covariance."""
    d = pf.width
    centre = batch_models(pf, batch, control, lambda m: (m.mean, np.eye(d)))
    fourth = _fourth_moments(pf, centre, batch, control, pf.names)

    def fit(m: la.Moments, row):
        return np.zeros(d), la.matrix_inv_sqrt(la.ledoit_wolf(m.scatter, m.n, row.fourth))

    return la.apply_models(pf, batch_models(pf, batch, control, fit, extra=fourth), batch, pf.names, missing=few)


def _eligible(pf: ProfileFrame, batch: str, control: Column) -> Column:
    """Controls of batches that have at least two of them, as a row condition."""
    return control & F.col("_n_ctl").isNotNull() & (F.col("_n_ctl") >= FEW_CONTROLS)


def _with_control_counts(pf: ProfileFrame, batch: str, control: Column) -> ProfileFrame:
    counts = control_counts(pf, batch, control).withColumnRenamed("n_controls", "_n_ctl")
    return pf.with_df(pf.df.join(counts, batch, "left"))


def tvn_original(pf: ProfileFrame, batch: str, control: Column, k: int = 50, epsilon: float = 1e-8, few: str = "zero",
                 dim_ratio_threshold: float = 2.5, dim_ratio_action: str = "clamp") -> ProfileFrame:
    """Whiten on pooled controls, then align each batch to identity (TVN_0...).

    ``few`` says what happens to batches with fewer than two controls: 'zero', 'keep' (whitened only) or 'drop'.
    """
    counted = _with_control_counts(pf, batch, control)
    usable = _eligible(counted, batch, control)
    k = clamp_components(min(k, pf.width), smallest_batch(pf, batch, control), dim_ratio_threshold, dim_ratio_action)
    found = principal_axes(counted, k, usable)
    white = la.apply_matrix(counted, found.mean, found.whitening(epsilon), [f"TVN_{i}" for i in range(k)])
    out = _shrunk_alignment(white, batch, usable, few)
    return out.with_df(out.df.drop("_n_ctl"))


def tvn_cascade(pf: ProfileFrame, batch: str, control: Column, k1: int = 100, k2: int = 10, epsilon: float = 1e-8,
                few: str = "zero") -> ProfileFrame:
    """A wide whitening on pooled controls, a narrow one on top, then alignment per batch."""
    counted = _with_control_counts(pf, batch, control)
    usable = _eligible(counted, batch, control)
    k1 = min(k1, pf.width)
    k2 = min(k2, k1)
    first = principal_axes(counted, k1, usable)
    wide = la.apply_matrix(counted, first.mean, first.whitening(epsilon), [f"W_{i}" for i in range(k1)])
    second = principal_axes(wide, k2, usable)
    narrow = la.apply_matrix(wide, second.mean, second.whitening(epsilon), [f"TVN_Cascade_{i}" for i in range(k2)])
    out = _shrunk_alignment(narrow, batch, usable, few)
    return out.with_df(out.df.drop("_n_ctl"))


def whitening_report(pf: ProfileFrame, batch: str, control: Column) -> DataFrame:
    """Per batch: controls, condition number of the control covariance, and the ill-conditioned flag."""
    shift = la.column_means(pf, control)
    tiles = la.moment_tiles(pf, [batch], control, shift)
    schema = T.StructType([tiles.schema[batch], T.StructField("n_controls", T.LongType()),
                           T.StructField("condition_number", T.DoubleType()), T.StructField("ill_conditioned", T.BooleanType())])
    key_type = to_arrow_type(tiles.schema[batch].dataType)

    def report(key, m: la.Moments, _):
        c = la.condition_number(m.cov()) if m.n >= FEW_CONTROLS else float("inf")
        yield pa.RecordBatch.from_arrays([pa.array([key], key_type), pa.array([m.n], pa.int64()), pa.array([c]), pa.array([c > la.ILL_CONDITIONED])],
                                         names=[f.name for f in schema])

    return la.per_key(tiles, batch, pf.width, shift, report, schema)
