"""Running sums and ranks that never put a whole key into one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from phenospark.operators.aggregate import GROUP_LIMIT


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
                 direct_limit: int = GROUP_LIMIT) -> DataFrame:
    """Inclusive running sums of integer columns per key in the given order (which must be total per key).

    Keys of checked size use one window. With a larger key, rows are range-partitioned by (key, order), summed
    inside the partitions and shifted by the totals of earlier partitions. The locally summed rows are written to
    the shared folder first, because a second evaluation could draw other range bounds.
    """
    from phenospark.session import materialize

    keys, order = list(keys), list(order)
    rows = df.withColumns({f"_s_{n}": c.cast("bigint") for n, c in sums.items()})
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= direct_limit:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(f"_s_{n}").over(w) for n in sums}).drop(*[f"_s_{n}" for n in sums])

    code = "_kh"
    ranged = (rows.withColumn(code, F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))
              .repartitionByRange(code, *keys, *order).sortWithinPartitions(code, *keys, *order)
              .withColumn("_pid", F.spark_partition_id()))
    names, locals_ = [f"_s_{n}" for n in sums], [f"_l_{n}" for n in sums]
    at = {c: i for i, c in enumerate(ranged.columns)}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            kh = b.column(at[code]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, kh[1:] != kh[:-1]])
            lengths = np.diff(np.r_[starts, len(kh)])
            outs = []
            for i, name in enumerate(names):
                total = np.cumsum(b.column(at[name]).to_numpy(zero_copy_only=False))
                base = np.repeat(np.r_[0, total[starts[1:] - 1]], lengths)
                run = total - base
                if kh[0] == last:
                    run[:lengths[0]] += carry[i]
                outs.append(run)
            last, carry = kh[-1], [int(o[-1]) for o in outs]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(o) for o in outs]],
                                             names=[*b.schema.names, *locals_])

    schema = T.StructType([*ranged.schema.fields, *[T.StructField(f"_l_{n}", T.LongType()) for n in sums]])
    summed = materialize(ranged.mapInArrow(local, schema), "running")
    totals = summed.groupBy(code, "_pid").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    w = W.partitionBy(code).orderBy("_pid")
    before = totals.select(code, "_pid", *[(F.sum(f"_t_{n}").over(w) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums])
    out = summed.join(before, [code, "_pid"])
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def running_least(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Per key the least value among rows of the same or a larger ``order`` (unique per key), over ranges of (key, order)."""
    from phenospark.session import materialize

    keys = list(keys)
    by = [*keys, F.desc(order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id())
    at, of_key = ranged.columns.index(value), [ranged.columns.index(k) for k in keys]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, np.inf
        for b in batches:
            if not b.num_rows:
                continue
            heads = list(zip(*(b.column(c).to_pylist() for c in of_key))) if keys else [()] * b.num_rows
            edges = [i for i in range(1, len(heads)) if heads[i] != heads[i - 1]] if keys else []
            values, run = b.column(at).to_numpy(zero_copy_only=False), np.empty(len(heads))
            for lo, hi in zip([0, *edges], [*edges, len(heads)]):
                run[lo:hi] = np.minimum.accumulate(values[lo:hi])
                if heads[lo] == last:
                    run[lo:hi] = np.minimum(run[lo:hi], least)
                last, least = heads[lo], run[hi - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run)], names=[*b.schema.names, "_run"])

    schema = T.StructType([*ranged.schema.fields, T.StructField("_run", T.DoubleType())])
    runs = materialize(ranged.mapInArrow(local, schema), "least")
    # a key reaches over few ranges: one row for each
    reach = runs.groupBy(*keys, "_pid").agg(F.min("_run").alias("_m"))
    earlier = reach.withColumn("_before", F.min("_m").over(W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)))
    joined = runs.join(F.broadcast(earlier.drop("_m")) if not keys else earlier.drop("_m"), [*keys, "_pid"])
    return joined.withColumn(out, F.least("_run", "_before")).drop("_pid", "_run", "_before")


def ordinal_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str = "rank", **kw) -> DataFrame:
    """1, 2, 3... by value within a key, ties in the order of the tie column."""
    return running_sums(df, keys, [value, tie], {out: F.lit(1)}, **kw)


def mean_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", **kw) -> DataFrame:
    """Rank by value within a key where ties share their mean rank."""
    return df.join(ranked_values(df, keys, value, out, **kw), [*keys, value])


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", **kw) -> DataFrame:
    """(keys, value, rank) once per distinct value, ties at their mean rank.

    Equal values are counted first, so a value held by a third of all rows is one row in the ordered pass.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sums(counts, keys, [value], {"_upto": F.col("_c")}, **kw)
    return upto.select(*keys, value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
