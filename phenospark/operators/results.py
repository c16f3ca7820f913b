"""Analytics over result rows: one score per (family, codec, config)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from phenospark.operators.relational import with_row


def best_row(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], largest: bool = True) -> DataFrame:
    """The row with the best score per group; ties go to the largest tie key. Combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(score, *tie))
    return df.groupBy(*keys).agg(pick.alias("_b")).select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def pinned_config(df: DataFrame, family: str, codec: str, config: str, score: str, reference: str) -> DataFrame:
    """Each family's best config at the reference codec, used at every codec.

    Codecs without that config fall back to their own best one.
    """
    pins = best_row(df.filter(F.col(codec) == reference).select(family, config, score), [family], score, [config])
    hit = df.join(pins.select(family, config), [family, config])
    rest = df.join(hit.select(family, codec).distinct(), [family, codec], "left_anti")
    fallback = best_row(rest, [family, codec], score, [config])
    return hit.unionByName(fallback.select(*hit.columns))


def best_configs(df: DataFrame, family: str, codec: str, config: str, score: str, mode: str, reference: str | None = None) -> DataFrame:
    """Config choice: per_codec, zstd_reference (pinned), best_any_codec, or best_avg_codec."""
    if mode == "per_codec":
        return best_row(df, [family, codec], score, [config])
    if mode == "zstd_reference":
        return pinned_config(df, family, codec, config, score, reference)
    if mode == "best_any_codec":
        pins = best_row(df.select(family, config, score), [family], score, [config])
    elif mode == "best_avg_codec":
        means = df.groupBy(family, config).agg(F.avg(score).alias(score))
        pins = best_row(means, [family], score, [config])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.join(pins.select(family, config), [family, config])


def with_selection_score(df: DataFrame, pa: str, pc: str, mode: str = "balanced", out: str = "best_score") -> DataFrame:
    """Score used for picking configs: product in percent, max-scaled product, or one metric alone."""
    if mode == "balanced":
        return df.withColumn(out, F.col(pa) * F.col(pc) / 100)
    if mode in ("pc", "pc_nap"):
        return df.withColumn(out, F.col(pc))
    if mode == "nap_balanced":
        top = with_row(df, df.agg(F.max(pa).alias("a"), F.max(pc).alias("c")), "_top")
        return top.withColumn(out, F.try_divide(F.col(pa), F.col("_top.a")) * F.try_divide(F.col(pc), F.col("_top.c"))).drop("_top")
    raise ValueError(f"unknown mode {mode!r}")


def baseline_codec(df: DataFrame, family: str, codec: str, preference: Sequence[str]) -> DataFrame:
    """Per family the first available codec of the preference list."""
    from phenospark.operators.relational import order_by_list

    rank = order_by_list(codec, preference)
    return df.groupBy(family).agg(F.min_by(codec, F.struct(rank, F.col(codec))).alias("baseline"))


def baseline_deltas(df: DataFrame, keys: Sequence[str], codec: str, score: str, baseline: DataFrame, family: str) -> DataFrame:
    """Differences to the baseline codec at equal config; NULL keys match NULL keys."""
    from phenospark.operators.relational import null_safe_join

    base = (df.join(F.broadcast(baseline), [family]).filter(F.col(codec) == F.col("baseline"))
            .select(*keys, F.col(score).alias("base_score")))
    joined = null_safe_join(df, base, keys)
    return joined.withColumn("delta", F.col(score) - F.col("base_score"))


def percent_delta(score: Column, base: Column, floor: float = 0.0, guard: float = 1e-12) -> Column:
    """Percent change of floored scores; NULL where the base is about zero."""
    s, b = F.greatest(score, F.lit(floor)), F.greatest(base, F.lit(floor))
    return F.when(F.abs(b) > guard, (s - b) / b * 100)


def balanced_root(pa: Column, pc: Column) -> Column:
    """Geometric mean of two scores floored at zero."""
    return F.sqrt(F.greatest(pa, F.lit(0.0)) * F.greatest(pc, F.lit(0.0)))


def macro_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], score: str) -> DataFrame:
    """Unweighted mean over inner groups of their means."""
    first = df.groupBy(*inner).agg(F.avg(score).alias(score))
    return first.groupBy(*outer).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("n_groups"))


def rank_within(df: DataFrame, keys: Sequence[str], score: str, out: str = "rank") -> DataFrame:
    from phenospark.operators.relational import average_rank

    return df.withColumn(out, average_rank(score, keys, descending=True))


def rank_stability(best: DataFrame, family: str, codec: str, score: str, extra: Sequence[str] = (), min_common: int = 3) -> DataFrame:
    """Spearman correlation of family scores for each pair of codecs.

    The input holds one row per (family, codec), so the self join is over result rows only.
    """
    from phenospark.operators.relational import average_rank
    from phenospark.operators.stats import pearson

    a = best.select(*extra, family, F.col(codec).alias("codec_a"), F.col(score).alias("sa"))
    b = best.select(*extra, family, F.col(codec).alias("codec_b"), F.col(score).alias("sb"))
    pairs = a.join(b, [*extra, family]).filter("codec_a < codec_b")
    keys = [*extra, "codec_a", "codec_b"]
    ranked = pairs.withColumns({"ra": average_rank("sa", keys), "rb": average_rank("sb", keys)})
    return (ranked.groupBy(*keys).agg(pearson("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_common))


def top_configs(df: DataFrame, family: str, codec: str, config: str, score: str, n: int) -> DataFrame:
    from phenospark.operators.relational import top_n_per_group

    return top_n_per_group(df, [family, codec], [F.col(score).desc_nulls_last(), F.col(config)], n)


def codec_delta_summary(deltas: DataFrame, keys: Sequence[str], col: str = "pct") -> DataFrame:
    return deltas.groupBy(*keys).agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("n"))


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without a result row."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def running_total(df: DataFrame, keys: Sequence[str], order: str, col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.sum(col).over(W.partitionBy(*keys).orderBy(order)))
