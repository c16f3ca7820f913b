"""Grouped aggregations: exact quantiles that survive hot groups, profiles, digests, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from phenospark.operators.frame import ProfileFrame, assemble

# Rows per group up to which one exact in-memory percentile per group is fine.
GROUP_LIMIT = 1_000_000


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    group_limit: int = GROUP_LIMIT, sizes: DataFrame | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    ``percentile`` keeps a group's distinct values in one task, so it serves only groups whose size was
    checked. Larger groups take a second way that is exact as well: an approximate sketch brackets each
    quantile, rows outside the bracket are only counted, and the few values inside are ranked.
    ``sizes`` may give rows with the same keys that are cheaper to count (one row per profile).
    """
    keys = list(keys)
    counted = (sizes if sizes is not None else df).select(*[k for k in keys if sizes is None or k in sizes.columns])
    size_keys = counted.columns
    counts = counted.groupBy(*size_keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 0

    def direct(rows: DataFrame) -> DataFrame:
        arr = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        out = rows.groupBy(*keys).agg(arr.alias("_q"))
        return out.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    if largest <= group_limit:
        return direct(df)
    if not size_keys:
        return _bracketed(df, keys, value, probs, names, group_limit)
    # One row per ``group_limit`` rows at most; a shuffled join would sort each large group in one task.
    hot = F.broadcast(counts.filter(F.col("_n") > group_limit).drop("_n"))
    # NULL keys never match in these joins, so they stay with the direct way.
    small = df.join(hot, size_keys, "left_anti")
    return direct(small).unionByName(_bracketed(df.join(hot, size_keys, "left_semi"), keys, value, probs, names, group_limit))


def _bracketed(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], names: Sequence[str], least: int) -> DataFrame:
    """Groups with more than ``least`` rows: the bracket spans the sketch's rank error and both neighbouring ranks."""
    accuracy = 10_000
    margin = 3e-4 + 2 / least
    rows = df.filter(F.col(value).isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx(value, [max(0.0, p - margin), min(1.0, p + margin)], accuracy).alias(f"_b{i}")
          for i, p in enumerate(probs)])
    result = None
    for i, (p, name) in enumerate(zip(probs, names)):
        bounds = sketch.select(*keys, "_n", F.col(f"_b{i}")[0].alias("_lo"), F.col(f"_b{i}")[1].alias("_hi"))
        marked = rows.join(F.broadcast(bounds), keys) if keys else rows.crossJoin(F.broadcast(bounds))
        marked = marked.filter(F.col(value) <= F.col("_hi"))
        # One entry per distinct value in the bracket; everything below collapses into one entry.
        slot = F.when(F.col(value) >= F.col("_lo"), F.col(value))
        cells = (marked.groupBy(*keys, slot.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")))
        w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_v").asc_nulls_first())
        h = (F.col("_n") - 1) * F.lit(float(p))
        ranked = cells.withColumn("_to", F.sum("_c").over(w)).withColumns({"_lowpos": F.floor(h), "_frac": h - F.floor(h)})
        start = F.col("_to") - F.col("_c")
        holds = lambda pos: (start <= pos) & (pos < F.col("_to"))
        upper = F.least(F.col("_lowpos") + 1, F.col("_n") - 1)
        picked = ranked.groupBy(*keys).agg(
            F.max(F.when(holds(F.col("_lowpos")), F.col("_v"))).alias("_a"),
            F.max(F.when(holds(upper), F.col("_v"))).alias("_z"), F.first("_frac").alias("_frac"))
        part = picked.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_frac")).alias(name))
        result = part if result is None else (result.join(part, keys) if keys else result.crossJoin(part))
    return result


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **kw) -> DataFrame:
    return group_quantiles(df, keys, value, [0.5], [name], **kw)


def group_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact median of each of the columns per group, under its own name; where no group is large, in one pass over the rows.

    Rows meet by key before they are aggregated, so maps of values are neither built twice nor shuffled.
    """
    keys = list(keys)
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if largest <= group_limit:
        return df.repartition(*keys).groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in values])
    from phenospark.operators.relational import null_safe_join

    out = None
    for v in values:
        part = group_median(df, keys, v, v, group_limit=group_limit)
        out = part if out is None else null_safe_join(out, part, keys)
    return out


def aggregate_profiles(pf: ProfileFrame, strata: Sequence[str], method: str = "median",
                       drop_null_keys: bool = False, **kw) -> ProfileFrame:
    """One profile per stratum: median or mean of each feature, metadata of the row with the smallest id."""
    strata = list(strata)
    df = pf.df.dropna(subset=strata) if drop_null_keys else pf.df
    rest = [c for c in pf.meta if c not in strata]
    meta = df.groupBy(*strata).agg(F.min_by(F.struct(*rest), F.col(pf.id_col)).alias("_m"))
    meta = meta.select(*strata, *[F.col("_m")[c].alias(c) for c in rest])
    long = pf.with_df(df).long(*strata)
    keys = [*strata, "idx"]
    if method == "median":
        cells = group_median(long, keys, "value", "v", sizes=df.select(*strata), **kw)
    elif method == "mean":
        cells = long.groupBy(*keys).agg(F.avg("value").alias("v"))
    else:
        raise ValueError(f"unknown method {method!r}")
    arrays = assemble(cells, strata, ["v"]).withColumnRenamed("v", "features")
    from phenospark.operators.relational import null_safe_join

    return ProfileFrame(null_safe_join(meta, arrays, strata), pf.names, pf.id_col)


def summarize(df: DataFrame, keys: Sequence[str], col: str, quantiles: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """n, mean, sample std, min, max and exact quantiles of a column per group."""
    from phenospark.operators.relational import null_safe_join

    basic = df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    names = [f"p{int(round(q * 100)):02d}" for q in quantiles]
    return null_safe_join(basic, group_quantiles(df, keys, col, quantiles, names), keys)


def sorted_unique_join(col: str, sep: str = "|") -> Column:
    """Sorted distinct strings joined by a separator; the set per group is the result."""
    return F.array_join(F.sort_array(F.collect_set(col)), sep)


def share(df: DataFrame, keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Count per key and percent of its enclosing group; only grouped rows enter the window."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*within))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def set_digest(df: DataFrame, key: Column, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of a key set: count plus sums of four 60-bit lanes of SHA-256.

    Sums combine on the map side, so no task ever holds the key list.
    """
    keyed = df.select(*by, F.sha2(key, 256).alias("_d")).distinct()
    lanes = [F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    out = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"_l{i}") for i, x in enumerate(lanes)])
    text = F.concat_ws("-", *[F.coalesce(F.col(f"_l{i}"), F.lit(0)).cast("string") for i in range(4)])
    return out.select(*by, "n", text.alias("digest"))


def fill_rate(df: DataFrame, plate: Sequence[str], well: str, capacity: int = 384) -> DataFrame:
    return df.groupBy(*plate).agg(
        F.round(F.countDistinct(well) / F.lit(capacity) * 100, 2).alias("fill_rate"))
