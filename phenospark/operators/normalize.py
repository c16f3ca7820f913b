"""Row-preserving normalizations. Statistics come from native aggregates over (batch, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.functions.scalar import with_normal_quantile
from phenospark.operators.aggregate import group_median
from phenospark.operators.frame import ProfileFrame, assemble, finite_or_null
from phenospark.operators.ordered import ordinal_rank
from phenospark.operators.relational import null_safe_join
from phenospark.session import materialize


def fit_rows(pf: ProfileFrame, batch: Sequence[str], control: Column | None) -> DataFrame:
    """Rows the statistics come from: a batch's controls, or all its rows when it has none."""
    if control is None:
        return pf.df
    flagged = pf.df.withColumn("_ctl", F.coalesce(control, F.lit(False)))
    has = flagged.groupBy(*batch).agg(F.max("_ctl").alias("_has"))
    joined = null_safe_join(flagged, has, batch) if batch else flagged.withColumn("_has", has.scalar())
    return joined.filter("_ctl OR NOT _has").drop("_ctl", "_has")


def _scaled(pf: ProfileFrame, stats: DataFrame, batch: Sequence[str], epsilon: float) -> ProfileFrame:
    """(x - centre) / (scale + epsilon) with one row of arrays per batch.

    The arrays are joined on the batch; AQE picks broadcast from the measured size and splits hot batches.
    """
    arrays = assemble(stats, batch, ["centre", "scale"])
    if batch:
        joined = null_safe_join(pf.df, arrays, batch, "left")
    else:
        joined = pf.df.withColumns({c: arrays.select(c).scalar() for c in ("centre", "scale")})
    scaled = F.transform("features", lambda x, i: (finite_or_null(x) - F.get(F.col("centre"), i))
                         / (F.get(F.col("scale"), i) + F.lit(epsilon)))
    return pf.with_df(joined.withColumn("features", scaled).drop("centre", "scale"))


def robust_mad(pf: ProfileFrame, batch: Sequence[str] = (), control: Column | None = None, epsilon: float = 1e-18,
               mad_divisor: float = 1.0, **kw) -> ProfileFrame:
    """(x - median) / (MAD + eps) per batch, fitted on controls where a batch has any.

    ``mad_divisor=1.4826`` gives the scaled variant.
    """
    batch = list(batch)
    return _scaled(pf, robust_statistics(pf, batch, control, mad_divisor, **kw), batch, epsilon)


def robust_statistics(pf: ProfileFrame, batch: Sequence[str] = (), control: Column | None = None,
                      mad_divisor: float = 1.0, **kw) -> DataFrame:
    """Median and MAD per (batch, feature): two passes over the rows the fit uses."""
    batch = list(batch)
    rows = pf.with_df(fit_rows(pf, batch, control))
    sizes = rows.df.select(*batch)
    centre = group_median(rows.long(*batch), [*batch, "idx"], "value", "centre", sizes=sizes, **kw)
    centres = assemble(centre, batch, ["centre"])
    near = null_safe_join(rows.df, centres, batch) if batch else rows.df.withColumn("centre", centres.scalar())
    deviation = F.transform("features", lambda x, i: F.abs(finite_or_null(x) - F.get(F.col("centre"), i)))
    spread = group_median(rows.with_df(near.withColumn("features", deviation)).long(*batch), [*batch, "idx"],
                          "value", "mad", sizes=sizes, **kw)
    both = null_safe_join(centre, spread, [*batch, "idx"])
    return both.select(*batch, "idx", "centre", (F.col("mad") / mad_divisor).alias("scale"))


def standardize(pf: ProfileFrame, batch: Sequence[str] = (), control: Column | None = None, epsilon: float = 1e-18) -> ProfileFrame:
    """(x - mean) / (population std + eps) with the same scoping."""
    batch = list(batch)
    return _scaled(pf, standard_statistics(pf, batch, control), batch, epsilon)


def standard_statistics(pf: ProfileFrame, batch: Sequence[str] = (), control: Column | None = None) -> DataFrame:
    rows = pf.with_df(fit_rows(pf, list(batch), control))
    return rows.long(*batch).groupBy(*batch, "idx").agg(
        F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale"))


def sample_normalize(pf: ProfileFrame, norm: str = "l2", epsilon: float = 1e-10) -> ProfileFrame:
    """Each row divided by its own norm."""
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    size = {
        "l1": lambda v: total(v, F.abs),
        "l2": lambda v: F.sqrt(total(v, lambda x: x * x)),
        "max": lambda v: F.array_max(F.transform(v, F.abs)),
    }[norm](F.col("features"))
    df = pf.df.withColumn("_norm", size + F.lit(epsilon))
    return pf.with_df(df.withColumn("features", F.transform("features", lambda x: x / F.col("_norm"))).drop("_norm"))


def well_position_correct(pf: ProfileFrame, well: str) -> ProfileFrame:
    """Subtract the mean of each position over all plates."""
    means = assemble(pf.long(well).groupBy(well, "idx").agg(F.avg("value").alias("centre")), [well], ["centre"])
    joined = null_safe_join(pf.df, means, [well], "left")
    shifted = F.transform("features", lambda x, i: x - F.get(F.col("centre"), i))
    return pf.with_df(joined.withColumn("features", shifted).drop("centre"))


def ordinal_ranks(pf: ProfileFrame, **kw) -> DataFrame:
    """(id, idx, rank) of finite values per feature, ties in id order."""
    long = pf.long(pf.id_col).filter(F.col("value").isNotNull())
    return ordinal_rank(long, ["idx"], "value", pf.id_col, **kw).select(pf.id_col, "idx", "rank")


def inverse_normal_transform(pf: ProfileFrame, **kw) -> ProfileFrame:
    """Blom scores (r - 3/8) / (n + 1/4) through the normal quantile; missing values stay missing.

    The rows are written once, because the count, the bounds of the ranges, the ranks and the result read them.
    """
    pf = pf.with_df(materialize(pf.df, "ranked"))
    n = pf.df.count()
    ranks = ordinal_ranks(pf, **kw).withColumn("_p", (F.col("rank") - 0.375) / F.lit(n + 0.25))
    scored = with_normal_quantile(ranks, "_p", "z").select(pf.id_col, "idx", "z")
    # One score per feature and row; features without a score stay NULL at their place.
    packed = scored.groupBy(pf.id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "z"))).alias("_z"))
    joined = pf.df.join(packed, pf.id_col, "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(pf.width - 1)), lambda i: F.try_element_at(F.col("_z"), i))
    return pf.with_df(joined.withColumn("features", values).drop("_z"))
