"""Embedding near-duplicates by an epsilon grid order join.

Cosine >= t between unit vectors is a distance of at most epsilon = sqrt(2 - 2t). Vectors are projected on leading principal
directions (fitted on a bounded sample of about ``sample`` vectors; any orthonormal directions keep the result exact) and
sorted by their grid cells of side epsilon, dimension by dimension. The sequence is joined with itself by intervals,
recursively: a pair of intervals whose bounding boxes are further apart than epsilon is skipped, first between blocks, then
inside a pair of blocks down to ``leaf`` vectors. What remains is compared in double precision.

Equal vectors are one class with a multiplicity, so copies cost nothing. Of the links a task returns per class their number
and a spanning forest, never the pairs.

Rows: one per input row. Vectors that are NULL, empty, zero, or hold NULL, NaN or infinite components link with nothing; so
do vectors of different lengths. NULL vec_id sorts last as a component's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.llm import components, intervals, texts as tx
from phenospark.llm.simhash import Forest

SLACK = 1e-9


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no vanishing norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(classes: DataFrame, k: int, sample: int) -> np.ndarray:
    """Leading principal directions of a bounded sample in hash order."""
    n = classes.count()
    share = F.pmod(F.xxhash64("cid"), F.lit(2**31)) / float(2**31)
    got = classes.where(share < min(1.0, sample / max(1, n))).select("v").toArrow()["v"].combine_chunks() if n else None
    if got is None or not len(got):
        got = classes.select("v").limit(1).toArrow()["v"].combine_chunks()
    x = _unit(_matrix(got))
    values, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], -1) if len(x) > 1 else np.eye(x.shape[1]))
    return vectors[:, ::-1][:, :k]


def _project(batches, directions: np.ndarray, epsilon: float):
    for batch in batches:
        lead = _unit(_matrix(batch.column(batch.schema.get_field_index("v")))) @ directions
        lists = lambda m, kind: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel(), kind))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists(lead, pa.float64()), lists(np.floor(lead / epsilon).astype(np.int32), pa.int32())], names=[*batch.schema.names, "lead", "cells"])


def _boxes_apart(k: int, epsilon: float):
    def near(a: str, b: str) -> Column:
        gap = lambda d: F.greatest(F.lit(0.0), F.col(f"{a}lo{d}") - F.col(f"{b}hi{d}"), F.col(f"{b}lo{d}") - F.col(f"{a}hi{d}"))
        return sum((gap(d) * gap(d) for d in range(k)), F.lit(0.0)) <= epsilon * epsilon + SLACK

    return near


def _join_intervals(x, lead_x, y, lead_y, same, threshold, epsilon, leaf):
    """Yields (rows of x, rows of y) linked, by splitting intervals until they are small or provably distant."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a:
            continue
        p, q = lead_x[a:b], lead_y[c:d]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if (gap * gap).sum() > epsilon * epsilon + SLACK:
            continue
        if b - a <= leaf and d - c <= leaf:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= threshold)
            i, j = i + a, j + c
            if same:
                ok = i < j
                i, j = i[ok], j[ok]
            if len(i):
                yield i, j
            continue
        halves = lambda s, e: [(s, (s + e) // 2), ((s + e) // 2, e)] if e - s > leaf else [(s, e)]
        stack += [(*u, *w) for u in halves(a, b) for w in halves(c, d)]


def _pair_links(batches, width, directions, threshold, epsilon, leaf):
    """(cid, links, root) for every class with links in a pair of blocks."""

    def side(got):
        cid, n, v = (x.to_numpy(zero_copy_only=False) for x in got)
        unit = _unit(v.astype(np.float64).reshape(-1, width))
        lead = unit @ directions
        by = np.lexsort((cid, *np.floor(lead / epsilon).T[::-1]))
        return cid[by], n[by], unit[by], lead[by]

    holder, left = None, None
    for own, other in intervals.partners(batches, ["cid", "n", "v"]):
        if own is not holder:
            holder, left = own, side(own)
        right, same = (left, True) if other is None else (side(other), False)
        shift = 0 if same else len(left[0])
        cid, many = (left[k] if same else np.concatenate((left[k], right[k])) for k in (0, 1))
        links, forest = np.zeros(len(cid), dtype=np.int64), Forest(len(cid))
        for i, j in _join_intervals(left[2], left[3], right[2], right[3], same, threshold, epsilon, leaf):
            j = j + shift
            links += np.bincount(i, weights=many[j], minlength=len(cid)).astype(np.int64)
            links += np.bincount(j, weights=many[i], minlength=len(cid)).astype(np.int64)
            forest.join(i, j)
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(cid[hit], pa.int64()), pa.array(links[hit], pa.int64()), pa.array(cid[forest.label[hit]], pa.int64())], names=["cid", "links", "root"])


def _links(classes: DataFrame, width: int, threshold: float, k: int, block: int, leaf: int, sample: int) -> DataFrame:
    epsilon = float(np.sqrt(2 - 2 * threshold))
    k = min(k, width)
    directions = _directions(classes, k, sample)
    lead = classes.select("cid", "n", "v").mapInArrow(lambda it: _project(it, directions, epsilon), f"{', '.join(f'{n} {t}' for n, t in classes.select('cid', 'n', 'v').dtypes)}, lead array<double>, cells array<int>")
    ranked = intervals.ranked_blocks(lead, [F.col("cells"), F.col("cid")], block)
    bounds = {}
    for d in range(k):
        bounds[f"lo{d}"] = lambda c: F.min(c)
        bounds[f"hi{d}"] = lambda c: F.max(c)
    rows = F.collect_list(F.struct("cid", "n", "v"))
    packed = ranked.groupBy("block").agg(rows.alias("rows"), *(F.min(F.col("lead")[d]).alias(f"lo{d}") for d in range(k)), *(F.max(F.col("lead")[d]).alias(f"hi{d}") for d in range(k)))
    blocks = tx.Stage(packed.select("block", F.col("rows.cid").alias("cid"), F.col("rows.n").alias("n"), F.flatten("rows.v").alias("v"), *bounds), "blocks")
    n_blocks = blocks.df.count()
    pairs = intervals.close_pairs(blocks.df, bounds, _boxes_apart(k, epsilon), n_blocks)
    return intervals.with_partners(pairs, blocks.df, ["cid", "n", "v"], n_blocks).mapInArrow(
        lambda it: _pair_links(it, width, directions, threshold, epsilon, leaf), "cid long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, k: int = 10, block: int = 2_048, leaf: int = 128, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    v = F.col("embedding").cast("array<double>")
    rows = tx.Stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_usable(v), F.col("embedding")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = tx.Stage(rows.df.where("v is not null").groupBy("v").agg(F.min("row").alias("cid"), F.count("*").alias("n"), F.min(F.coalesce("vec_id", F.lit(tx.LAST_ID))).alias("least")), "classes")
    found = None
    for (width,) in sorted(classes.df.select(F.size("v")).distinct().collect()):
        part = _links(classes.df.where(F.size("v") == width), width, threshold, k, block, leaf, sample)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = tx.Stage(found, "links")
    groups, _ = components.connected_components(links.df.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    counted = links.df.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.df.join(counted, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    answer = rows.df.join(named.select("v", "n", "links", "component_id"), "v", "left")
    own = F.coalesce("vec_id", F.lit(tx.LAST_ID))
    component = F.coalesce("component_id", own)
    return answer.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), tx.public_id(component).alias("component_id"), (own == component).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole of embeddings at a cosine of 0.95."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
