"""Ranking one row against many without writing out the pairs.

Rows meet in tiles: rows of the same key are cut into hash blocks, and each (query block, reference block)
becomes one bounded matrix product inside a task. A tile answers with sums per query, never with pairs:

* ``similarity_histogram``: how many partners fall on each similarity step,
* ``count_above``: how many partners lie above each of the query's own thresholds.

A key with a third of all rows only means more tiles; they are spread by hash like all others. Similarities
are compared on a fixed grid (``resolution``), which also decides ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from phenospark.operators.linalg import to_matrix
from phenospark.session import materialize

RESOLUTION = 1e-6
BLOCK_ROWS = 1024
# A tile has so many reference rows for each of its query rows.
REFS_PER_QUERY = 4
# A query's thresholds travel once per reference block. Where there are any, a tile has more references, which stream past
# its queries, and more queries if the key has many references, but only so many thresholds.
STREAM_BLOCKS, ASKED_BLOCKS, ASKED_THRESHOLDS = 256, 4, 4_000_000
# Where every pair is counted by its step, a tile is held whole: so many blocks, or so many bytes of vectors, of each side.
WHOLE_BLOCKS, WHOLE_BYTES = 64, 32 << 20
# Keys of more than one tile are sent to all tasks, up to so many.
CUT_KEYS = 1_000_000
# Threshold below every similarity: its count is the number of partners.
EVERYTHING = -(2 ** 62)


def unit(vector: Column) -> Column:
    """Row scaled to length one; a zero row stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    # The norm rides along as a one-element array, so it is computed once per row and not once per element.
    return F.flatten(F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)),
                                 lambda n: F.transform(vector, lambda x: x / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def grid_step(similarity: Column, resolution: float = RESOLUTION) -> Column:
    return F.rint(similarity / F.lit(resolution)).cast("bigint")


def code(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def side(df: DataFrame, id_col: str, keys: Sequence[str], differ: Sequence[str] = (), vector: str = "features",
         labels: str | None = None, thresholds: str | None = None, self_col: str | None = None, carry: Column | None = None) -> DataFrame:
    """One side of the comparison: key code, id, vector, codes that must differ, label codes, thresholds.

    A row never meets itself; ``self_col`` names the row when the id does not. ``carry``, an array of longs, comes back with the
    answer, so it needs no join.
    """
    return df.dropna(subset=list(keys)).select(
        F.xxhash64(*[F.col(k) for k in keys]).alias("_k") if keys else F.lit(0).cast("bigint").alias("_k"),
        F.col(id_col).alias("_id"),
        F.col(vector).alias("_v"),
        F.array(code(self_col or id_col), *[code(c) for c in differ]).alias("_codes"),
        (F.transform(labels, lambda x: F.xxhash64(x)) if labels else F.lit(None).cast("array<bigint>")).alias("_labels"),
        (F.col(thresholds) if thresholds else F.lit(None).cast("array<bigint>")).alias("_thr"),
        *([] if carry is None else [carry.alias("_carry")]),
    )


def place(id_col: str, keys: Sequence[str], differ: Sequence[str] = ()) -> Column:
    """Key and codes of a row's side of another comparison, to be carried; a row without a key is alone in its own."""
    alone = F.xxhash64(F.col(id_col), F.lit("alone"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    key = F.when(known, F.xxhash64(*[F.col(k) for k in keys])).otherwise(alone) if keys else F.lit(0).cast("bigint")
    return F.array(key, code(id_col), *[code(c) for c in differ])


def placed_side(answers: DataFrame, thresholds: Column, carry: Column) -> DataFrame:
    """The side of the comparison that answers with a carried ``place`` take next."""
    return answers.select(F.col("_carry")[0].alias("_k"), "_id", "_v", F.slice("_carry", 2, F.size("_carry")).alias("_codes"),
                          F.lit(None).cast("array<bigint>").alias("_labels"), thresholds.alias("_thr"), carry.alias("_carry"))


def _cut_keys(queries: DataFrame, refs: DataFrame, width: int, block: int, above: bool) -> DataFrame:
    """(_k, _nq, _nr): how many blocks of queries and references a key has, for keys with more than one tile."""
    zero, one = F.lit(0), F.lit(1)
    asked = F.coalesce(F.size("_thr"), zero) if above else zero
    rows = queries.select("_k", one.alias("_q"), asked.alias("_t"), zero.alias("_r")).unionByName(
        refs.select("_k", zero.alias("_q"), zero.alias("_t"), one.alias("_r")))
    sums = rows.groupBy("_k").agg(*[F.sum(c).alias(c) for c in ("_q", "_t", "_r")]).filter("_q > 0 AND _r > 0")
    held = max(REFS_PER_QUERY * block, min(WHOLE_BLOCKS * block, WHOLE_BYTES // (8 * width + 64)))
    most, refs_held = (ASKED_BLOCKS * block, STREAM_BLOCKS * block) if above else (held, held)
    per_block = F.least(F.lit(most), F.greatest(F.lit(block), F.col("_r") / 64))
    n_q = F.col("_q") / per_block
    if above:
        n_q = F.greatest(n_q, F.col("_t") / ASKED_THRESHOLDS)
    sizes = sums.select("_k", F.ceil(n_q).cast("int").alias("_nq"), F.ceil(F.col("_r") / refs_held).cast("int").alias("_nr"))
    return materialize(sizes.filter("_nq > 1 OR _nr > 1"), "cut")


def _tiles(queries: DataFrame, refs: DataFrame, block: int, above: bool = False, width: int = 1) -> DataFrame:
    cut = _cut_keys(queries, refs, width, block, above)
    n_cut = cut.count()

    def sized(df: DataFrame) -> DataFrame:
        """Rows of most keys are one tile, so they are neither joined nor shuffled for that."""
        if n_cut:
            joined = df.join(F.broadcast(cut) if n_cut <= CUT_KEYS else cut, "_k", "left")
            return joined.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("_nq", "_nr")})
        return df.withColumns({"_nq": F.lit(1), "_nr": F.lit(1)})

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n).cast("bigint")).cast("int")
    body = ["_id", "_v", "_codes", "_labels", "_thr", (F.col("_nr") == 1).alias("_whole")]
    if "_carry" in queries.columns:
        body.append("_carry")
        refs = refs.withColumn("_carry", F.lit(None).cast(queries.schema["_carry"].dataType))
    q = (sized(queries).withColumn("_qb", own("_nq")).withColumn("_rb", spread("_nr"))
         .select(F.xxhash64("_k", "_qb", "_rb").alias("_tile"), F.lit(0).alias("_tag"), *body))
    r = (sized(refs).withColumn("_rb", own("_nr")).withColumn("_qb", spread("_nq"))
         .select(F.xxhash64("_k", "_qb", "_rb").alias("_tile"), F.lit(1).alias("_tag"), *body))
    spark = queries.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return q.unionByName(r).repartition(n_parts, "_tile").sortWithinPartitions("_tile", "_tag")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column; a NULL row counts as empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]


def _overlap(flat, offsets, q: slice, r: slice) -> np.ndarray:
    """Which query and reference rows of a tile share a label."""
    lo, hi = offsets[q.start], offsets[r.stop]
    codes, inverse = np.unique(flat[lo:hi], return_inverse=True)
    member = np.zeros((r.stop - q.start, max(len(codes), 1)), dtype=np.float32)
    member[np.repeat(np.arange(r.stop - q.start), np.diff(offsets[q.start:r.stop + 1])), inverse] = 1.0
    n_q = q.stop - q.start
    return member[:n_q] @ member[r.start - q.start:].T > 0


def _complete_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches that hold whole tiles; a tile cut by a batch border is carried over."""
    carry: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        tiles = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(tiles[1:] != tiles[:-1]) + 1
        held = carry[-1].column(0)[-1].as_py() if carry else tiles[0]
        cut = int(starts[-1]) if len(starts) else 0
        if held != tiles[0]:
            yield pa.concat_batches(carry)
            carry = []
        if cut:
            yield pa.concat_batches([*carry, b.slice(0, cut)])
            carry = []
        carry.append(b.slice(cut))
    if carry:
        yield pa.concat_batches(carry)


def _streamed_tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Whole tiles, except that a tile of more than ``most`` references comes in portions, each behind all its queries.

    The flag says that the last tile goes on.
    """
    carry: list[pa.RecordBatch] = []
    n_refs = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        tiles = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(tiles[1:] != tiles[:-1]) + 1
        cut = int(starts[-1]) if len(starts) else 0
        if carry and carry[-1].column(0)[-1].as_py() != tiles[0]:
            yield pa.concat_batches(carry), False
            carry, n_refs = [], 0
        if cut:
            yield pa.concat_batches([*carry, b.slice(0, cut)]), False
            carry, n_refs = [], 0
        carry.append(b.slice(cut))
        n_refs += int(carry[-1].column(1).to_numpy(zero_copy_only=False).sum())
        if n_refs >= most:
            rows = pa.concat_batches(carry)
            yield rows, True
            carry, n_refs = [rows.slice(0, rows.num_rows - n_refs)], 0
            if not carry[0].num_rows:  # references without queries of their own
                carry = [rows.slice(rows.num_rows - 1)]
    if carry:
        yield pa.concat_batches(carry), False


def _similarities(a: np.ndarray, b: np.ndarray, metric: str, resolution: float) -> np.ndarray:
    """Similarities on the grid, in 32 bits where they fit: those sort several times as fast."""
    s = a @ b.T
    if metric == "euclidean":
        np.multiply(s, -2, out=s)
        s += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
        np.negative(np.sqrt(np.maximum(s, 0.0, out=s), out=s), out=s)
    np.rint(np.divide(s, resolution, out=s), out=s)
    return s.astype(np.int32 if -LIMIT32 < s.min() and s.max() < LIMIT32 else np.int64)


LIMIT32 = 2.0 ** 31 - 2


# Tiles of so many pairs, in rows of so many, are sorted row by row.
DENSE_PAIRS, DENSE_WIDTH = 1 << 14, 64


class _Sorted:
    """The similarity steps of a large tile, each query's in order; pairs that do not count come first."""

    def __init__(self, first: int, steps: np.ndarray, q_codes: np.ndarray, r_codes: np.ndarray, ok: np.ndarray | None):
        self.first = first
        ok = np.ones(steps.shape, bool) if ok is None else ok
        for c in range(q_codes.shape[1]):
            ok &= q_codes[:, c:c + 1] != r_codes[:, c]
        self.low, self.steps = int(np.iinfo(steps.dtype).min), steps
        np.copyto(steps, self.low, where=~ok)
        self.steps.sort(axis=1)
        self.left_out = ok.shape[1] - ok.sum(axis=1)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, step, count) of equal steps of a query."""
        n, width = self.steps.shape
        new = np.ones((n, width), bool)
        new[:, 1:] = self.steps[:, 1:] != self.steps[:, :-1]
        new[self.steps == self.low] = False
        row, at = np.nonzero(new)
        ends = np.r_[np.where(row[1:] == row[:-1], at[1:], width), [width] * (len(row) > 0)]
        return self.first + row, self.steps[row, at].astype(np.int64), ends - at

    def beyond(self, thr: tuple[np.ndarray, np.ndarray], or_equal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, threshold, count of the query's steps above it) of queries that have any."""
        n, width = self.steps.shape  # thresholds are cut to the range of the steps
        side, rows, counts = "left" if or_equal else "right", [], []
        lo, hi = thr[1][self.first], thr[1][self.first + n]
        levels = thr[0][lo:hi]
        cut = np.clip(levels, self.low + 1, -self.low - 1).astype(self.steps.dtype)
        edges = (thr[1][self.first:self.first + n + 1] - lo).tolist()
        asked = np.flatnonzero(self.left_out < width)
        for i in asked.tolist():
            counts.append(width - self.steps[i].searchsorted(cut[edges[i]:edges[i + 1]], side=side))
            rows.append(edges[i + 1] - edges[i])
        kept = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in asked.tolist()]) if len(asked) else np.zeros(0, int)
        return self.first + np.repeat(asked, rows), levels[kept], np.concatenate(counts) if counts else np.zeros(0, int)


def _tile_steps(rows: pa.RecordBatch, width: int, metric: str, resolution: float, exclude_shared_labels: bool,
                sign: int, thr=None, bins: tuple[int, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray] | _Sorted]:
    """(query row, similarity step) of the admissible pairs of whole tiles, some millions at a time; large tiles sorted."""
    tile = rows.column(0).to_numpy(zero_copy_only=False)
    tag = rows.column(1).to_numpy(zero_copy_only=False)
    x = to_matrix(rows.column(3), width)
    codes = rows.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(tile), -1)
    labels = _lists(rows.column(5)) if exclude_shared_labels else None
    starts = np.r_[0, np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile)]
    first_ref = np.r_[0, np.cumsum(tag)]
    binned = (lambda found: found) if bins is None else lambda found: (found.astype(np.int64) + bins[0]) // bins[1]
    at, steps, held = [], [], 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        m = e - int(first_ref[e] - first_ref[s])
        if m == s or m == e:
            continue
        at_once = BLOCK_ROWS if thr is not None else max(1, WHOLE_PAIRS // (e - m))
        if e - m >= DENSE_WIDTH and m - s > at_once:
            for a in range(s, m, at_once):
                z = min(a + at_once, m)
                found = binned(_similarities(x[a:z], x[m:e], metric, resolution))
                yield _Sorted(a, found if sign == 1 else -found, codes[a:z], codes[m:e], ~_overlap(*labels, slice(a, z), slice(m, e)) if labels is not None else None)
            continue
        found = binned(_similarities(x[s:m], x[m:e], metric, resolution))
        if found.size >= DENSE_PAIRS and (thr is None or found.shape[1] >= DENSE_WIDTH):
            yield _Sorted(s, found if sign == 1 else -found, codes[s:m], codes[m:e], ~_overlap(*labels, slice(s, m), slice(m, e)) if labels is not None else None)
            continue
        ok = codes[s:m, :1] != codes[m:e, 0]
        for c in range(1, codes.shape[1]):
            ok &= codes[s:m, c:c + 1] != codes[m:e, c]
        if labels is not None:
            ok &= ~_overlap(*labels, slice(s, m), slice(m, e))
        per_row = ok.sum(axis=1)
        kept = int(per_row.sum())
        at.append(np.repeat(np.arange(s, m), per_row))
        steps.append((found.ravel() if kept == found.size else found[ok]).astype(np.int64))
        held += kept
        # Portions end at tile borders, so a query's answer for a tile is never split.
        if held > PAIRS_AT_ONCE:
            yield np.concatenate(at), sign * np.concatenate(steps)
            at, steps, held = [], [], 0
    if held:
        yield np.concatenate(at), sign * np.concatenate(steps)


# Pairs a task holds in memory before it reduces them to counts.
PAIRS_AT_ONCE = 2_000_000
# Pairs of a large tile whose steps are sorted at once, if each is to be counted.
WHOLE_PAIRS = 1 << 22


def _count_steps(at: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, step, count) of equal steps of a query."""
    order = np.lexsort((steps, at))
    at, steps = at[order], steps[order]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (steps[1:] != steps[:-1])])
    return at[first], steps[first], np.diff(np.r_[first, len(at)])


def _count_beyond(at: np.ndarray, steps: np.ndarray, thr: tuple[np.ndarray, np.ndarray], or_equal: bool):
    """(query row, threshold, count of the query's steps above it)."""
    asked = np.unique(at)
    n_thr = thr[1][asked + 1] - thr[1][asked]
    rows = np.repeat(asked, n_thr)
    levels = thr[0][np.repeat(thr[1][asked] - np.r_[0, np.cumsum(n_thr)[:-1]], n_thr) + np.arange(n_thr.sum())]
    lo, hi = int(steps.min()), int(steps.max())
    span, n_asked = hi - lo + 3, len(asked)
    if span * n_asked < 2 ** 62:
        # Usual case: place every step among its query's sorted thresholds, then count from the top.
        local = np.searchsorted(asked, rows)
        keys = local * span + np.clip(levels - lo + 1, 0, span - 1)
        order = np.argsort(keys, kind="stable")
        step_keys = np.searchsorted(asked, at) * span + (steps - lo + 1)
        # Slot of a step: the number of thresholds it is above.
        slot = np.searchsorted(keys[order], step_keys, side="right" if or_equal else "left")
        gained = np.bincount(slot, minlength=len(keys) + 1)
        total = np.cumsum(gained[::-1])[::-1]
        # Steps of later queries lie in later slots; a query's own last slot is shared with none of them.
        own = np.bincount(np.searchsorted(asked, at), minlength=n_asked)
        later = np.r_[np.cumsum(own[::-1])[::-1][1:], 0]
        counts = np.empty(len(keys), dtype=np.int64)
        counts[order] = total[np.arange(len(keys)) + 1] - later[local[order]]
        return rows, levels, counts
    # Very wide steps: one sort of steps and thresholds together; the kind decides who comes first among equals.
    n = len(at)
    kind = np.r_[np.zeros(n, np.int8), np.full(len(rows), -1 if or_equal else 1, np.int8)]
    order = np.lexsort((kind, np.r_[steps, levels], np.r_[at, rows]))
    is_step = order < n
    seen = np.cumsum(is_step)
    position = np.empty(len(order), dtype=np.int64)
    position[order] = seen
    ends = np.cumsum(np.bincount(np.searchsorted(asked, at), minlength=len(asked)))
    return rows, levels, ends[np.searchsorted(asked, rows)] - position[n:]


# References of a tile that a task compares at once, in values of their vectors.
STREAM_VALUES = 1 << 20


def _scan(queries: DataFrame, refs: DataFrame, width: int, metric: str, resolution: float, block: int,
          exclude_shared_labels: bool, sign: int, above: bool, or_equal: bool, value_names: tuple[str, ...],
          bins: tuple[int, int] | None = None) -> DataFrame:
    tiles = _tiles(queries, refs, block, above, width)
    # What a query carries comes back with its answer, and with it the vector of a query that goes on to another comparison.
    carried = [n for n in (("_carry",) if above else ("_v", "_carry")) if "_carry" in tiles.columns]
    places = [tiles.columns.index(n) for n in carried]
    pack = lambda offsets, v: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v.astype(np.int64)))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _complete_tiles(batches):
            for found in _tile_steps(rows, width, metric, resolution, exclude_shared_labels, sign, bins=bins):
                row, level, count = found.counts() if isinstance(found, _Sorted) else _count_steps(*found)
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    offsets, at_first = np.r_[first, len(row)], pa.array(row[first])
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(2).take(at_first), rows.column(7).take(at_first), pack(offsets, level), pack(offsets, count),
                         *(rows.column(p).take(at_first) for p in places)],
                        names=["_id", "_whole", *value_names, *carried])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, open_total, open_seen = max(64, min(REFS_PER_QUERY * block, STREAM_VALUES // width)), None, None
        for rows, goes_on in _streamed_tiles(batches, most):
            thr = _lists(rows.column(6))
            total, seen = np.zeros(len(thr[0]), dtype=np.int64), np.zeros(rows.num_rows, bool)
            if open_total is not None:
                total[:len(open_total)], seen[:len(open_seen)] = open_total, open_seen
                open_total = None
            for found in _tile_steps(rows, width, metric, resolution, exclude_shared_labels, sign, thr):
                row, _, count = found.beyond(thr, or_equal) if isinstance(found, _Sorted) else _count_beyond(*found, thr, or_equal)
                if len(row):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    # A query's counts are those of its thresholds, in their order.
                    total[np.arange(len(row)) + np.repeat(thr[1][row[first]] - first, np.diff(np.r_[first, len(row)]))] += count
                    seen[row[first]] = True
            done = rows.num_rows
            if goes_on:
                tile = rows.column(0).to_numpy(zero_copy_only=False)
                done = int(np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])[-1])
                open_total, open_seen = total[thr[1][done]:], seen[done:done + int((rows.column(1).to_numpy(zero_copy_only=False)[done:] == 0).sum())]
            if carried:  # all queries answer, those without partners too
                seen |= rows.column(1).to_numpy(zero_copy_only=False) == 0
            found = np.flatnonzero(seen[:done])
            if len(found):
                lengths = thr[1][found + 1] - thr[1][found]
                offsets = np.r_[0, np.cumsum(lengths)]
                at, of = np.arange(offsets[-1]) + np.repeat(thr[1][found] - offsets[:-1], lengths), pa.array(found)
                levels = [pack(offsets, thr[0][at])] if len(value_names) > 1 else []
                yield pa.RecordBatch.from_arrays([rows.column(2).take(of), rows.column(7).take(of), *levels, pack(offsets, total[at]),
                                                  *(rows.column(p).take(of) for p in places)], names=["_id", "_whole", *value_names, *carried])

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([tiles.schema["_id"], tiles.schema["_whole"], *[T.StructField(n, longs) for n in value_names],
                           *[T.StructField(n, tiles.schema[n].dataType) for n in carried]])
    return _merged(materialize(tiles.mapInArrow(counts if above else histogram, schema), "tiles"), value_names, above, carried)


def _merged(raw: DataFrame, names: tuple[str, ...], aligned: bool, carried: Sequence[str] = ()) -> DataFrame:
    """One ascending list of (step, value) per query, or its values alone.

    A query whose references lie in one tile has its list already; lists of several tiles are summed per step. ``aligned``
    lists have the query's own thresholds as steps, in the same order in every tile.
    """
    listed = (F.sort_array(F.arrays_zip(*names)) if len(names) > 1 else F.col(names[0])).alias("_list")
    whole = raw.filter("_whole").select("_id", listed, *carried)
    rest = raw.filter("NOT _whole")
    if rest.isEmpty():
        return whole

    def with_carried(lists: DataFrame) -> DataFrame:
        return lists.join(rest.groupBy("_id").agg(*[F.any_value(n).alias(n) for n in carried]), "_id") if carried else lists

    if aligned:
        return whole.unionByName(with_carried(_added(rest, names[0], names[-1]).select("_id", listed)))
    step, value = names
    flat = rest.select("_id", F.inline(F.arrays_zip(step, value)))
    sums = flat.groupBy("_id", step).agg(F.sum(value).alias(value))
    lists = sums.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(step, value))).alias("_list"))
    return whole.unionByName(with_carried(lists))


def _added(rest: DataFrame, step: str, value: str) -> DataFrame:
    """Lists of a query added up position by position, as they stream past in order of the queries."""
    names = list(dict.fromkeys([step, value]))
    parted = rest.select("_id", *names).repartition("_id").sortWithinPartitions("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, steps, total = None, None, None
        for b in batches:
            ids, done = b.column(0), []
            (s, at), (v, _) = _lists(b.column(1)), _lists(b.column(len(names)))
            for i, key in enumerate(ids.to_pylist()):
                lo, hi = at[i], at[i + 1]
                if key == current:
                    total = total + v[lo:hi]
                    continue
                if steps is not None:
                    done.append((current, steps, total))
                current, steps, total = key, s[lo:hi], v[lo:hi]
            if done:
                yield _listed(done, b.schema)
        if steps is not None:
            yield _listed([(current, steps, total)], schema)

    schema = pa.schema([("_id", to_arrow_type(rest.schema["_id"].dataType)), *((n, pa.list_(pa.int64())) for n in names)])
    return parted.mapInArrow(run, parted.schema)


def _listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    pack = lambda n: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r[n]) for r in rows])].astype(np.int32)), pa.array(np.concatenate([r[n] for r in rows])))
    values = [pack(1), pack(2)][3 - len(schema.names):]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], schema.field(0).type), *values], names=schema.names)


def similarity_histogram(queries: DataFrame, refs: DataFrame, width: int, metric: str = "cosine",
                         resolution: float = RESOLUTION, block: int = BLOCK_ROWS, bins: tuple[int, int] | None = None) -> DataFrame:
    """(_id, _list of (step, n)): partners of each query per similarity step, ascending.

    With ``bins`` (shift, size) steps are counted by floor((step + shift) / size), and that number is the step. Queries that carry
    something come back with it and their vector.
    """
    return _scan(queries, refs, width, metric, resolution, block, False, 1, False, False, ("step", "n"), bins)


def count_above(queries: DataFrame, refs: DataFrame, width: int, metric: str = "cosine", resolution: float = RESOLUTION,
                block: int = BLOCK_ROWS, exclude_shared_labels: bool = False, sign: int = 1, or_equal: bool = False, steps: bool = True) -> DataFrame:
    """(_id, _list of (step, above)): partners beyond each threshold of the query (``or_equal``: or on it).

    Without ``steps`` the list has the counts alone, in the order of the query's thresholds.

    ``sign=-1`` ranks by dissimilarity; thresholds are then given for the negated similarity. Queries that carry something come
    back with it, those without partners too.
    """
    return _scan(queries, refs, width, metric, resolution, block, exclude_shared_labels, sign, True, or_equal, ("step", "above") if steps else ("above",))


def partner_counts(queries: DataFrame, refs: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Queries with the size of their reference group (an upper bound of their partners)."""
    if not keys:
        return queries.withColumn(out, refs.agg(F.count(F.lit(1))).scalar())
    sizes = refs.groupBy(*[F.col(k).alias(f"_{out}_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(out))
    cond = [queries[k] == sizes[f"_{out}_{k}"] for k in keys]
    return queries.join(sizes, cond, "left").drop(*[f"_{out}_{k}" for k in keys]).fillna(0, [out])
