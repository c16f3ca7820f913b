"""Moment matrices by partial sums on the executors, small dense algebra on d x d matrices.

Moments travel as tiles of the upper triangle, at most ``TILE`` x ``TILE`` cells (2 MB) each, so no row grows with the square of
the width. Whole matrices exist only inside the task (or the driver) that decomposes one; leading axes need none (``axes``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phenospark.operators.frame import ProfileFrame

# Bytes of partial sums one task keeps before it hands them on.
PARTIAL_BYTES = 256 * 1024 * 1024


def to_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width matrix from an Arrow list column; NULL elements become NaN."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    return np.asarray(values, dtype=np.float64).reshape(len(column), width)


def to_list_array(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def column_means(pf: ProfileFrame, where: Column | None = None) -> np.ndarray:
    """Mean of each feature: d numbers on the driver."""
    df = pf.df.filter(where) if where is not None else pf.df
    rows = pf.with_df(df).long().groupBy("idx").agg(F.avg("value").alias("m")).collect()
    out = np.zeros(pf.width)
    for r in rows:
        out[r["idx"]] = r["m"] if r["m"] is not None else 0.0
    return out


def _by_key(columns: Sequence[pa.Array], x: np.ndarray) -> Iterator[tuple[tuple, np.ndarray]]:
    """The matrix rows of each key of a batch."""
    codes = np.zeros(len(x), dtype=np.int64)
    for c in columns:
        encoded = c.dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    for s, e in zip(starts, np.r_[starts[1:], len(x)]):
        yield tuple(c[int(order[s])].as_py() for c in columns), x[order[s:e]]


TILE = 512
# Partial tiles of one key meet in so many tasks before they meet in one.
TREE = 32


def blocks_of(d: int, tile: int = TILE) -> list[tuple[int, int]]:
    return [(lo, min(lo + tile, d)) for lo in range(0, d, tile)]


def tile_type(df: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    """Keys, block row and column, count and sums (on the diagonal), cells."""
    doubles = T.ArrayType(T.DoubleType())
    return T.StructType([*(df.schema[k] for k in keys), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                         T.StructField("n", T.LongType()), T.StructField("s", doubles), T.StructField("g", doubles), *more])


class _TileRows:
    """Collects tiles into record batches of some megabytes."""

    def __init__(self, types: Sequence[pa.DataType], names: Sequence[str], limit: int = 4 << 20):
        self.types, self.names, self.limit = list(types), list(names), limit
        self._reset()

    def _reset(self):
        self.rows, self.sums, self.cells, self.held = [], [], [], 0

    def add(self, head: tuple, i: int, j: int, n: int, s: np.ndarray, g: np.ndarray):
        self.rows.append((*head, i, j, n))
        self.sums.append(s)
        self.cells.append(g)
        self.held += 8 * len(g)

    def full(self) -> bool:
        return self.held >= self.limit

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            heads = [pa.array(c, t) for c, t in zip(zip(*self.rows), [*self.types, pa.int32(), pa.int32(), pa.int64()])]
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in v])].astype(np.int32)), pa.array(np.concatenate(v)))
                     for v in (self.sums, self.cells)]
            yield pa.RecordBatch.from_arrays([*heads, *lists], names=[*self.names, "i", "j", "n", "s", "g"])
            self._reset()


def row_slices(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column of doubles, as views."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _sum_sorted(tiles: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Tiles that agree in ``by`` added up, one at a time, as they stream past in order."""
    keys = list(keys)
    parted = tiles.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, n, s, g = None, None, 0, None, None
        for b in batches:
            columns = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            if out is None:
                out = _TileRows([columns[k].type for k in keys], keys)
            heads = list(zip(*(columns[k].to_pylist() for k in [*keys, "i", "j"])))
            for head, m, sums, cells in zip(heads, columns["n"].to_pylist(), row_slices(columns["s"]), row_slices(columns["g"])):
                if current is not None and _same(head, current):
                    n, s, g = n + m, s + sums, g + cells
                    continue
                if current is not None:
                    out.add(current[:-2], *current[-2:], n, s, g)
                    if out.full():
                        yield from out.batch()
                current, n, s, g = head, m, sums, cells
        if current is not None:
            out.add(current[:-2], *current[-2:], n, s, g)
            yield from out.batch()

    return parted.mapInArrow(run, tile_type(tiles, keys))


def sum_tiles(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum per (keys, i, j): first under salts, so that no task takes in all partial tiles of a key, then over them."""
    keys = list(keys)
    salted = tiles.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    first = _sum_sorted(salted, [*keys, "i", "j", "_salt"], [*keys, "_salt"])
    return _sum_sorted(first, [*keys, "i", "j"], keys)


def moment_tiles(pf: ProfileFrame, keys: Sequence[str] = (), where: Column | None = None, shift: np.ndarray | None = None,
                 tile: int = TILE) -> DataFrame:
    """Tiles (keys, i, j, n, s, g) of X'X of shifted rows, i <= j; counts and sums X'1 come with the diagonal ones.

    Each task sums its own rows, so a key with a third of all rows costs one partial matrix per task.
    The shift (the overall mean) keeps the sums well conditioned.
    """
    keys, d = list(keys), pf.width
    if shift is None:
        shift = column_means(pf, where)
    df = pf.df.filter(where) if where is not None else pf.df
    rows = df.select(*keys, F.transform("features", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("features"))
    spans = blocks_of(d, tile)
    most = max(1, PARTIAL_BYTES // (4 * d * (d + tile)))
    none = np.zeros(0)

    def emit(sums, out):
        for key, (n, s, g) in sums.items():
            for (i, j), cells in g.items():
                a, b = spans[i]
                out.add(key, i, j, n if i == j else 0, s[a:b] if i == j else none, cells.ravel())
                if out.full():
                    yield from out.batch()
        yield from out.batch()

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, out = {}, None
        for b in batches:
            if b.num_rows == 0:
                continue
            own = b.columns[:len(keys)]
            out = out or _TileRows([c.type for c in own], keys)
            for key, part in _by_key(own, to_matrix(b.column(len(keys)), d) - shift):
                n, s, g = sums.get(key) or (0, np.zeros(d), {})
                for i, (a, e) in enumerate(spans):
                    for j, (c, f) in enumerate(spans[i:], i):
                        product = part[:, a:e].T @ part[:, c:f]
                        if (i, j) in g:
                            g[i, j] += product
                        else:
                            g[i, j] = product
                sums[key] = (n + len(part), s + part.sum(0), g)
            if len(sums) > most:
                yield from emit(sums, out)
                sums = {}
        if out:
            yield from emit(sums, out)

    return sum_tiles(rows.mapInArrow(partials, tile_type(df, keys)), keys)


def moment_table(pf: ProfileFrame, keys: Sequence[str] = (), where: Column | None = None,
                 shift: np.ndarray | None = None) -> DataFrame:
    """One row per key: the flattened d x (d + 2) matrix [X'X | X'1 | n] of shifted rows, for features of one tile."""
    d = pf.width
    if d > TILE:
        raise ValueError(f"{d} features make rows too large; take moment_tiles")
    row = lambda r: F.concat(F.slice("g", r * d + 1, F.lit(d)), F.slice("s", r + 1, F.lit(1)), F.array(F.col("n").cast("double")))
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), row))
    return moment_tiles(pf, keys, where, shift).select(*keys, whole.alias("moments"))


@dataclass(frozen=True)
class Moments:
    """Count, mean and centred cross-product matrix."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, tiles, d: int, shift: np.ndarray, tile: int = TILE) -> "Moments":
        """From all tiles (i, j, n, s, g) of a key."""
        spans, whole, sums, n = blocks_of(d, tile), np.zeros((d, d)), np.zeros(d), 0
        for i, j, count, s, g in tiles:
            (a, b), (c, e) = spans[i], spans[j]
            whole[a:b, c:e] = np.reshape(g, (b - a, e - c))
            if i == j:
                n, sums[a:b] = count, s
            else:
                whole[c:e, a:b] = whole[a:b, c:e].T
        whole -= np.outer(sums, sums / n)
        return cls(n, shift + sums / n, (whole + whole.T) / 2)

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / (self.n - ddof)

    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.scatter))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = self.scatter / np.outer(sd, sd)
        return np.clip(np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0), -1, 1)


def global_moments(pf: ProfileFrame, where: Column | None = None) -> Moments:
    """Moments of all rows (or those under a condition), put together from tiles on the driver."""
    shift = column_means(pf, where)
    found = moment_tiles(pf, (), where, shift).toArrow()
    if not found.num_rows:
        raise ValueError("no rows to fit on")
    column = lambda c: found.column(c).combine_chunks()
    heads = zip(*(column(c).to_pylist() for c in "ijn"))
    return Moments.of([(*h, s, g) for h, s, g in zip(heads, row_slices(column("s")), row_slices(column("g")))], pf.width, shift)


def per_key(tiles: DataFrame, key: str, d: int, shift: np.ndarray, answer, schema: T.StructType, kind: str | None = None,
            extra: Sequence[str] = ()) -> DataFrame:
    """``answer(key, moments, extra values)`` for each key, whose tiles stream into one matrix in a task.

    With a column ``kind`` only a key's tiles of its smallest kind count.
    """
    order = [key, *([kind] if kind else []), "i", "j"]
    parted = tiles.repartition(key).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chosen, held, more = None, None, [], {}
        for b in batches:
            columns = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            names = [key, *([kind] if kind else [key]), "i", "j", "n"]
            values = [columns[e].to_pylist() for e in extra]
            for at, (k, kd, i, j, n) in enumerate(zip(*(columns[c].to_pylist() for c in names))):
                if current is None or not _same((k,), current):
                    if held:
                        yield from answer(current[0], Moments.of(held, d, shift), more)
                    current, chosen, held = (k,), kd, []
                    more = {e: v[at] for e, v in zip(extra, values)}
                if _same((kd,), (chosen,)):
                    held.append((i, j, n, columns["s"][at].values.to_numpy(zero_copy_only=False), columns["g"][at].values.to_numpy(zero_copy_only=False)))
        if held:
            yield from answer(current[0], Moments.of(held, d, shift), more)

    return parted.mapInArrow(run, schema)


# ---- dense algebra on d x d matrices -----------------------------------------------------------

EIGEN_FLOOR = 1e-10
ILL_CONDITIONED = 1e10


def matrix_power(a: np.ndarray, p: float, floor: float = EIGEN_FLOOR) -> np.ndarray:
    """Power of a symmetric positive semi-definite matrix; eigenvalues are floored first."""
    lam, v = np.linalg.eigh(a)
    return (v * np.maximum(lam, floor) ** p) @ v.T


def matrix_sqrt(a: np.ndarray) -> np.ndarray:
    return matrix_power(a, 0.5)


def matrix_inv_sqrt(a: np.ndarray) -> np.ndarray:
    return matrix_power(a, -0.5)


def condition_number(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def is_ill_conditioned(a: np.ndarray, limit: float = ILL_CONDITIONED) -> bool:
    return condition_number(a) > limit


def singular_values(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (descending) and right vectors (columns) of the centred data, from its scatter.

    As many as a thin decomposition has: min(n, d).
    """
    lam, v = np.linalg.eigh(m.scatter)
    rank = min(m.n, len(lam))
    order = np.argsort(lam)[::-1][:rank]
    return np.sqrt(np.maximum(lam[order], 0.0)), v[:, order]


def svd_whitening(m: Moments, epsilon: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(whitening matrix, colouring matrix)."""
    s, v = singular_values(m)
    root = np.sqrt(m.n - 1)
    return v * (root / (s + epsilon)), v * ((s + epsilon) / root)


def zca_whitening(m: Moments, epsilon: float = 1e-6) -> np.ndarray:
    s, v = singular_values(m)
    return (v * (np.sqrt(m.n - 1) / (s + epsilon))) @ v.T


def regularized_inverse(a: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    return np.linalg.inv(a + epsilon * np.eye(len(a)))


def pca_whitening(m: Moments, k: int, epsilon: float = 1e-8) -> np.ndarray:
    """Top-k principal axes scaled to unit variance."""
    lam, v = np.linalg.eigh(m.cov())
    order = np.argsort(lam)[::-1][:k]
    return v[:, order] / np.sqrt(np.maximum(lam[order], epsilon))


def ledoit_wolf(scatter: np.ndarray, n: int, fourth: float) -> np.ndarray:
    """Shrunk covariance (Ledoit and Wolf 2004) from the scatter and the sum of squared squared norms."""
    p = len(scatter)
    emp = scatter / n
    mu = np.trace(emp) / p
    total = float((emp ** 2).sum())
    distance = (total - p * mu * mu) / p
    noise = min((fourth / n - total) / (n * p), distance)
    weight = 0.0 if noise <= 0 or distance <= 0 else noise / distance
    return (1 - weight) * emp + weight * mu * np.eye(p)


def pca_components(m: Moments, n_components: int | float) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, explained variance ratio). A float asks for that share of the variance."""
    lam, v = np.linalg.eigh(m.cov())
    order = np.argsort(lam)[::-1]
    lam, v = np.maximum(lam[order], 0.0), v[:, order]
    ratio = lam / lam.sum() if lam.sum() > 0 else lam
    if isinstance(n_components, float):
        k = min(int(np.searchsorted(np.cumsum(ratio), n_components)) + 1, len(lam))
    else:
        k = min(n_components, len(lam))
    # The sign is free: make the largest loading of each axis positive.
    axes = v[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return axes, ratio[:k]


# ---- applying a matrix to every row ------------------------------------------------------------

# Bytes of models that may be sent to every executor, and of a model's matrix in one row.
BROADCAST_BYTES = 128 * 1024 * 1024
MODEL_ROW_BYTES = 4 * 1024 * 1024


def model_type(key: T.StructField) -> T.StructType:
    """A model is one row (key, part, mu, m) or several: the rows of its matrix in order of parts, the mean with the first."""
    doubles = T.ArrayType(T.DoubleType())
    return T.StructType([key, T.StructField("part", T.IntegerType()), T.StructField("mu", doubles), T.StructField("m", doubles)])


def model_rows(key, key_type: pa.DataType, name: str, mu: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    m = np.ascontiguousarray(m, dtype=np.float64).reshape(len(m), -1)
    step = max(1, MODEL_ROW_BYTES // (8 * max(1, m.shape[1])))
    for part, lo in enumerate(range(0, len(m), step)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], key_type), pa.array([part], pa.int32()), to_list_array(np.reshape(mu, (1, -1)) if not part else np.zeros((1, 0))),
             to_list_array(m[lo:lo + step].reshape(1, -1))], names=[name, "part", "mu", "m"])


def apply_matrix(pf: ProfileFrame, mu: np.ndarray, m: np.ndarray, names: Sequence[str]) -> ProfileFrame:
    """(x - mu) @ m for every row with one model whose size is d x k."""
    from pyspark.sql.functions import arrow_udf

    d = pf.width
    shared = pf.df.sparkSession.sparkContext.broadcast((np.asarray(mu), np.asarray(m)))

    @arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        mean, matrix = shared.value
        return to_list_array((to_matrix(x, d) - mean) @ matrix)

    return ProfileFrame(pf.df.withColumn("features", project("features")), tuple(names), pf.id_col)


def _applied(x: np.ndarray, model, width: int, missing: str) -> pa.Array | None:
    """Rows times their model, filled up to ``width`` with NULL; what ``missing`` says without one."""
    if model is None:
        return {"keep": lambda: to_list_array(x), "zero": lambda: to_list_array(np.zeros((len(x), width))), "drop": lambda: None}[missing]()
    out = (x - model[0]) @ model[1]
    if out.shape[1] == width:
        return to_list_array(out)
    whole = np.zeros((len(x), width))
    whole[:, :out.shape[1]] = out
    mask = np.ones((len(x), width), bool)
    mask[:, :out.shape[1]] = False
    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(whole.ravel(), mask=mask.ravel()))


def apply_models(pf: ProfileFrame, models: DataFrame, key: str, names: Sequence[str], missing: str = "keep",
                 broadcast_bytes: int = BROADCAST_BYTES, width_col: str | None = None) -> ProfileFrame:
    """Apply the model of each row's key: features become (x - mu) @ m.

    ``models`` has rows (key, part, mu, m). Rows without a model (those of a NULL key among them) are kept, dropped or set to zero. Models narrower than
    ``names`` leave the last features NULL; ``width_col`` adds each row's width. Models are broadcast when their total size
    was found small; otherwise rows travel to their model in sorted streams, with hot keys cut into hash blocks that each get
    a copy of the model.
    """
    d, k = pf.width, len(names)
    if missing == "keep" and d != k:
        raise ValueError("rows without a model can only be kept when the width stays the same")
    if "part" not in models.columns:
        models = models.withColumn("part", F.lit(0))
    if (models.agg(F.sum(8 * (F.size("mu") + F.size("m")))).first()[0] or 0) > broadcast_bytes:
        return _apply_streamed(pf, models, key, names, missing, width_col)
    base = pf.df.drop("features")
    kept, schema = base.columns, _applied_type(base, width_col)
    table = {}
    for r in models.orderBy(key, "part").toLocalIterator():
        table.setdefault(r[key], ([], []))[0].extend(r["mu"])
        table[r[key]][1].extend(r["m"])
    table = {q: (np.array(mu), np.array(m).reshape(d, -1)) for q, (mu, m) in table.items()}
    shared = pf.df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            encoded = b.column(b.schema.get_field_index(key)).dictionary_encode(null_encoding="encode")
            labels, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
            found = [shared.value.get(label) if label is not None else None for label in labels]
            at_once = d * k <= SMALL_MODEL and b.num_rows < KEY_ROWS * len(labels)
            small = np.array([at_once and m is not None and m[1].shape == (d, k) for m in found], bool)
            if small.any():
                rows = np.flatnonzero(small[codes])
                whole = [m for m, s in zip(found, small) if s]
                yield from _applied_by_row(b.take(pa.array(rows)), kept, d, k, (np.cumsum(small) - 1)[codes[rows]], whole, width_col)
            order = np.argsort(codes, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(codes[order])) + 1, len(codes)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi > lo and not small[codes[order[lo]]]:
                    yield from _answered(b.take(pa.array(order[lo:hi])), kept, d, k, found[codes[order[lo]]], missing, width_col)

    return ProfileFrame(pf.df.mapInArrow(run, schema), tuple(names), pf.id_col)


# Cells of a model up to which each row gets a copy of it, if keys have so few rows of a record batch: it then takes no step per key.
SMALL_MODEL, KEY_ROWS, COPIED_CELLS = 256, 64, 1 << 20


def _applied_by_row(rows: pa.RecordBatch, kept: Sequence[str], d: int, k: int, codes: np.ndarray, models: Sequence, width_col: str | None) -> Iterator[pa.RecordBatch]:
    """Rows in their order, each times the model of its code."""
    mean, matrix = (np.stack([m[i] for m in models]) for i in (0, 1))
    step, width = max(1, COPIED_CELLS // (d * k)), [width_col] if width_col else []
    for lo in range(0, len(codes), step):
        part, code = rows.slice(lo, step), codes[lo:lo + step]
        x = to_matrix(part.column(part.schema.get_field_index("features")), d) - mean[code]
        out = to_list_array((x[:, None, :] @ matrix[code])[:, 0])
        columns = [part.column(part.schema.get_field_index(c)) for c in kept]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.full(len(part), k, np.int32)) for _ in width], out], names=[*kept, *width, "features"])


def _applied_type(base: DataFrame, width_col: str | None) -> T.StructType:
    more = [T.StructField(width_col, T.IntegerType())] if width_col else []
    return T.StructType([*base.schema.fields, *more, T.StructField("features", T.ArrayType(T.DoubleType()))])


def _answered(rows: pa.RecordBatch, kept: Sequence[str], d: int, k: int, model, missing: str, width_col: str | None) -> Iterator[pa.RecordBatch]:
    out = _applied(to_matrix(rows.column(rows.schema.get_field_index("features")), d), model, k, missing)
    if out is not None:
        width = model[1].shape[1] if model is not None else k
        more = [pa.array(np.full(len(rows), width, np.int32))] if width_col else []
        columns = [rows.column(rows.schema.get_field_index(c)) for c in kept]
        yield pa.RecordBatch.from_arrays([*columns, *more, out], names=[*kept, *([width_col] if width_col else []), "features"])


def _apply_streamed(pf: ProfileFrame, models: DataFrame, key: str, names: Sequence[str], missing: str,
                    width_col: str | None = None, block_rows: int = 50_000) -> ProfileFrame:
    """Rows and models meet in sorted partitions: each (key, block) starts with its model's rows."""
    d, k = pf.width, len(names)
    base = pf.df.drop("features")
    kept = base.columns
    sizes = pf.df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nb"))
    rows = (pf.df.join(sizes, pf.df[key].eqNullSafe(sizes[key]), "left").drop(sizes[key])
            .withColumn("_b", F.pmod(F.xxhash64(pf.id_col), F.col("_nb").cast("bigint")).cast("int")).drop("_nb")
            .withColumns({"_tag": F.lit(2**31 - 1), "_mu": F.lit(None).cast("array<double>")}))
    heads = (models.join(sizes, key).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
             .select(key, "_b", F.col("mu").alias("_mu"), F.col("m").alias("features"), F.col("part").alias("_tag")))
    both = heads.unionByName(rows, allowMissingColumns=True).select(*base.columns, "features", "_b", "_tag", "_mu")
    parted = both.repartition(key, "_b").sortWithinPartitions(key, "_b", "_tag")

    def run(batches):
        current, mu, parts, model = None, [], [], None
        for b in batches:
            names_ = b.schema.names
            col = lambda n: b.column(names_.index(n))
            labels = list(zip(col(key).to_pylist(), col("_b").to_pylist()))
            is_row = col("_tag").to_numpy(zero_copy_only=False) == 2**31 - 1
            i = 0
            while i < len(labels):
                if labels[i] != current:
                    current, mu, parts, model = labels[i], [], [], None
                if not is_row[i]:
                    mu.append(col("_mu")[i].values.to_numpy(zero_copy_only=False))
                    parts.append(col("features")[i].values.to_numpy(zero_copy_only=False))
                    i += 1
                    continue
                if model is None and parts:
                    model = (np.concatenate(mu), np.concatenate(parts).reshape(d, -1))
                j = i
                while j < len(labels) and labels[j] == current and is_row[j]:
                    j += 1
                yield from _answered(b.slice(i, j - i), kept, d, k, model, missing, width_col)
                i = j

    return ProfileFrame(parted.mapInArrow(run, _applied_type(base, width_col)), tuple(names), pf.id_col)
