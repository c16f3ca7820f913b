"""Comparing two variants of a dataset: correlations, distribution distances, replicate agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phenospark.functions.scalar import correlation_p_value
from phenospark.operators.aggregate import group_median, group_medians
from phenospark.operators.frame import finite_or_null
from phenospark.operators.ordered import ranked_values, running_sums
from phenospark.operators.relational import null_safe_join
from phenospark.session import materialize


def pearson(a: str, b: str, min_n: int = 2) -> Column:
    """Correlation over rows where both are present; NULL for too few rows or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    usable = (F.count_if(both) >= min_n) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    # From its parts: the built-in correlation fails on a constant side in ANSI mode.
    return F.when(usable, F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))


def match_objects(a: DataFrame, b: DataFrame, mapping: DataFrame, site: str, a_label: str, b_label: str, values: Sequence[str]) -> DataFrame:
    """Values of matched objects side by side as ``<value>_a`` and ``<value>_b``."""
    left = a.select(site, F.col("label").alias(a_label), *[F.col(v).alias(f"{v}_a") for v in values])
    right = b.select(site, F.col("label").alias(b_label), *[F.col(v).alias(f"{v}_b") for v in values])
    return mapping.join(left, [site, a_label]).join(right, [site, b_label])


def paired_long(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, feature, a, b) rows from ``<value>_a`` / ``<value>_b`` columns in one pass."""
    cells = F.array(*[F.struct(F.lit(v).alias("feature"), finite_or_null(F.col(f"{v}_a")).alias("a"),
                               finite_or_null(F.col(f"{v}_b")).alias("b")) for v in values])
    return df.select(*keys, F.inline(cells))


def feature_correlations(pairs: DataFrame, keys: Sequence[str], min_n: int = 2) -> DataFrame:
    return pairs.groupBy(*keys).agg(pearson("a", "b", min_n).alias("r"),
                                    F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n"))


def pair_diagnostics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Validity and spread of both sides, covariance sums, and medians."""
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = pairs.withColumns({"a": F.when(ok, F.col("a")), "b": F.when(ok, F.col("b"))})
    stats = both.groupBy(*keys).agg(
        F.count_if(F.col("a").isNotNull()).alias("n_valid"),
        (1 - F.count("a") / F.count(F.lit(1))).alias("nan_rate"),
        *[f(c).alias(f"{c}_{n}") for c in ("a", "b") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("var", F.var_pop))],
        F.covar_pop("a", "b").alias("covariance"))
    for c in ("a", "b"):
        stats = null_safe_join(stats, group_median(both, keys, c, f"{c}_median"), keys)
    return stats


def low_correlation_cause(r: Column, limit: float = 0.01) -> Column:
    """Label why a feature correlates near zero, from the columns of ``pair_diagnostics``."""
    least, most = F.least("a_std", "b_std"), F.sqrt(F.col("a_var") * F.col("b_var"))
    shift = F.abs(F.col("a_mean") - F.col("b_mean")) / F.greatest(F.col("a_std"), F.lit(1e-10))
    cause = (F.when(least < 1e-10, "constant").when(least < 1e-6, "near-constant").when(shift > 3, "mean shift")
             .when(F.col("nan_rate") * 100 > 5, "high missing rate")
             .when(F.abs("covariance") < most * 0.01, "no covariance").otherwise("unexplained"))
    return F.when(F.abs(r) < limit, cause)


def site_level(cells: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Medians per site and feature of the given columns, under their names; rows with a NULL key are left out."""
    return group_medians(cells.dropna(subset=list(keys)), keys, values)


def common_features(df: DataFrame, feature: str, variant: str, n_variants: int) -> DataFrame:
    """Features present in every variant."""
    return df.groupBy(feature).agg(F.countDistinct(variant).alias("_n")).filter(F.col("_n") == n_variants).select(feature)


def spearman(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", min_n: int = 3, **kw) -> DataFrame:
    """Rank correlation per key over rows where both values are finite; NULL below ``min_n`` rows.

    The rows are written once, because both rankings and the correlation read them.
    """
    rows = df.select(*keys, finite_or_null(F.col(a)).alias("_a"), finite_or_null(F.col(b)).alias("_b")).dropna(subset=["_a", "_b"])
    rows = materialize(rows, "spearman")
    ranks = {c: ranked_values(rows, keys, f"_{c}", f"_r{c}", **kw) for c in ("a", "b")}
    ranked = rows.join(ranks["a"], [*keys, "_a"]).join(ranks["b"], [*keys, "_b"])
    return ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) >= min_n, pearson("_ra", "_rb", min_n)).alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_test(df: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b", min_n: int = 3, **kw) -> DataFrame:
    """Rank correlation per key with the two-sided p-value of no association."""
    return spearman(df, keys, a, b, min_n, **kw).withColumn("p_value", correlation_p_value(F.col("rho"), F.col("n")))


def two_sample_cdf(df: DataFrame, keys: Sequence[str], value: str, is_a: str, **kw) -> DataFrame:
    """Running fractions of both samples at each distinct value; rows with NULL ``is_a`` only add values."""
    counts = df.groupBy(*keys, value).agg(F.count_if(F.col(is_a)).alias("_ca"), F.count_if(~F.col(is_a)).alias("_cb"))
    run = running_sums(counts, keys, [value], {"_na": F.col("_ca"), "_nb": F.col("_cb")}, **kw)
    totals = counts.groupBy(*keys).agg(F.sum("_ca").alias("_ta"), F.sum("_cb").alias("_tb"))
    joined = run.join(totals, list(keys))
    return joined.withColumns({"fa": F.try_divide("_na", "_ta"), "fb": F.try_divide("_nb", "_tb")})


def distribution_distances(df: DataFrame, keys: Sequence[str], value: str, is_a: str, **kw) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 distance, the latter also over the pooled std.

    Wasserstein is the sum of x * (gap before x - gap after x), so no neighbour lookup is needed.
    """
    cdf = two_sample_cdf(df.filter(F.col(value).isNotNull()), keys, value, is_a, **kw)
    after = F.abs(F.col("fa") - F.col("fb"))
    before = F.abs(F.try_divide(F.col("_na") - F.col("_ca"), F.col("_ta")) - F.try_divide(F.col("_nb") - F.col("_cb"), F.col("_tb")))
    dist = cdf.groupBy(*keys).agg(F.max(after).alias("ks"), F.sum(F.col(value) * (before - after)).alias("wasserstein"))
    return dist.join(effect_sizes(df, keys, value, is_a), list(keys)).withColumn(
        "wasserstein_scaled", F.when(F.col("pooled_std") > 0, F.col("wasserstein") / F.col("pooled_std")))


def effect_sizes(df: DataFrame, keys: Sequence[str], value: str, is_a: str, cap: float = 100.0) -> DataFrame:
    """Cohen's d on the mean of the two sample variances, and the variance ratio (largest over smallest, capped)."""
    x, y = F.when(F.col(is_a), F.col(value)), F.when(~F.col(is_a), F.col(value))
    s = df.groupBy(*keys).agg(F.avg(x).alias("_ma"), F.avg(y).alias("_mb"), F.var_samp(x).alias("_va"), F.var_samp(y).alias("_vb"))
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    high, low = F.greatest("_va", "_vb"), F.least("_va", "_vb")
    ratio = F.when(low > 0, F.least(high / low, F.lit(cap))).when(high > 0, F.lit(cap)).otherwise(F.lit(1.0))
    return s.select(*keys, pooled.alias("pooled_std"),
                    F.when(pooled > 0, F.abs(F.col("_ma") - F.col("_mb")) / pooled).alias("cohens_d"), ratio.alias("variance_ratio"))


def replicate_pairs(df: DataFrame, plate: str, treatment: str, well: str) -> DataFrame:
    """The first two wells (in order) of each plate and treatment, as one row."""
    from phenospark.operators.relational import top_n_per_group

    two = top_n_per_group(df.select(plate, treatment, well).distinct(), [plate, treatment], [F.col(well)], 2)
    both = two.groupBy(plate, treatment).agg(F.min(well).alias("well_a"), F.max(well).alias("well_b"))
    return both.filter("well_a <> well_b")


def delta_to_reference(df: DataFrame, keys: Sequence[str], variant: str, reference: str, values: Sequence[str]) -> DataFrame:
    """Differences of each variant's values to the reference variant at the same keys."""
    base = df.filter(F.col(variant) == reference).select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values])
    joined = null_safe_join(df.filter(F.col(variant) != reference), base, keys)
    return joined.select(*keys, variant, *[(F.col(v) - F.col(f"_r_{v}")).alias(f"delta_{v}") for v in values])


def cosine_between_features(pf) -> DataFrame:
    """Mean, std, max and min cosine of each feature to the other features, from the uncentred Gram matrix."""
    import numpy as np

    from phenospark.operators.linalg import global_moments

    m = global_moments(pf)
    g = m.scatter + m.n * np.outer(m.mean, m.mean)
    norm = np.sqrt(np.diag(g))
    norm[norm == 0] = 1.0
    c = g / np.outer(norm, norm)
    rows = []
    for i, name in enumerate(pf.names):
        other = np.delete(c[i], i)
        rows.append((name, float(other.mean()), float(other.std()), float(other.max()), float(other.min())))
    return pf.df.sparkSession.createDataFrame(rows, "feature string, mean double, std double, max double, min double")


def replicate_lists(corr: DataFrame, value: str, green: float = 0.9, red: float = 0.5) -> DataFrame:
    """'green' for well-reproduced features, 'red' for poorly reproduced ones."""
    label = F.when(F.col(value) >= green, "green").when(F.col(value) < red, "red")
    return corr.withColumn("list", label).filter(F.col("list").isNotNull())


def match_rate(n_matched: Column, n_total: Column) -> Column:
    return F.when(n_total > 0, n_matched / n_total)
