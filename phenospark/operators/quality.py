"""Release checks: every rule becomes a row (rule, ok, observed, expected)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.operators.aggregate import set_digest
from phenospark.operators.frame import ProfileFrame
from phenospark.operators.relational import missing_and_extra


def invalid_cells(pf: ProfileFrame) -> DataFrame:
    """NaN, infinite and missing feature cells, and the rows that hold any."""
    size = lambda test: F.size(F.filter("features", test))
    n_nan = size(lambda x: F.isnan(x))
    n_inf = size(lambda x: F.abs(x) == float("inf"))
    n_null = size(lambda x: x.isNull())
    return pf.df.agg(
        F.sum(n_nan).alias("n_nan"), F.sum(n_inf).alias("n_inf"), F.sum(n_null).alias("n_null"),
        F.count_if(n_nan + n_inf + n_null > 0).alias("n_rows"))


def check_features(pf: ProfileFrame, step: str, abort: bool = True) -> dict:
    """Counts of bad cells after a step; raises when asked to and any exist."""
    counts = invalid_cells(pf).first().asDict()
    if abort and (counts["n_nan"] or counts["n_inf"] or counts["n_null"]):
        raise ValueError(f"bad feature values after {step}: {counts}")
    return counts


def leading_variance(pf: ProfileFrame, n: int = 2) -> list[float]:
    """Variance share of the first principal axes."""
    from phenospark.operators.axes import principal_axes

    return [float(x) for x in principal_axes(pf, n).ratio]


def check_leading_variance(pf: ProfileFrame, most: float = 0.4, abort: bool = True) -> float:
    share = leading_variance(pf, 1)[0]
    if abort and share > most:
        raise ValueError(f"first axis holds {share:.3f} of the variance, more than {most}")
    return share


def expect(df: DataFrame, rules: Sequence[tuple[str, Column, object]]) -> DataFrame:
    """One aggregation for all rules of a table: (name, observed aggregate, expected value)."""
    row = df.agg(*[obs.cast("string").alias(f"o{i}") for i, (_, obs, _) in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"o{i}"), F.lit("0")).alias("observed"),
                               F.lit(str(e).lower() if isinstance(e, bool) else str(e)).alias("expected"))
                      for i, (n, _, e) in enumerate(rules)])
    return row.select(F.inline(cells)).withColumn("ok", F.col("observed") == F.col("expected"))


def malformed_keys(df: DataFrame, key: str, parts: int = 5, sep: str = "__") -> DataFrame:
    split = F.split(F.col(key), sep)
    return df.filter((F.size(split) != parts) | F.exists(split, lambda x: x == "") | F.col(key).isNull())


def compare_variants(keys: DataFrame, variant: str, key: str, canonical: DataFrame) -> DataFrame:
    """Per variant: missing and extra keys against the canonical set, and whether the digests agree."""
    wanted = canonical.select(key).distinct()
    have = keys.select(variant, key).distinct()
    flagged = have.join(wanted.withColumn("_c", F.lit(True)), key, "left")
    n_wanted = wanted.agg(F.count(F.lit(1))).scalar()
    known = F.count("_c")
    counts = flagged.groupBy(variant).agg(F.count(F.lit(1)).alias("n_keys"), known.alias("_known"),
                                          (F.count(F.lit(1)) - known).alias("n_extra"))
    counts = counts.withColumn("n_missing", n_wanted - F.col("_known")).drop("_known")
    target = set_digest(wanted, F.col(key)).select("digest").scalar()
    digests = set_digest(have, F.col(key), [variant]).select(variant, (F.col("digest") == target).alias("same_digest"))
    return counts.join(digests, variant)


def compare_inventory(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return missing_and_extra(actual, expected, keys)


def quarantine_plan(keys: DataFrame, canonical: DataFrame, key: str, root: str = "quarantine") -> DataFrame:
    """Surplus rows with the place they would move to; nothing is moved."""
    surplus = keys.join(canonical.select(key).distinct(), key, "left_anti")
    return surplus.withColumn("destination", F.concat_ws("/", F.lit(root), F.split(F.col(key), "__")[0], F.col(key)))


def check_digest(df: DataFrame, key: Column, n: int, digest: str) -> DataFrame:
    found = set_digest(df, key)
    return found.select("n", "digest", ((F.col("n") == n) & (F.col("digest") == digest)).alias("ok"))


def file_checksums(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, md5) of files, one task per group of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("md5"))


def check_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (name, length, md5) against the files; a missing file fails."""
    f = found.select("name", F.col("length").alias("_l"), F.col("md5").alias("_m"))
    joined = manifest.join(f, "name", "left")
    ok = (F.col("length") == F.col("_l")) & (F.col("md5") == F.col("_m"))
    return joined.select("name", F.coalesce(ok, F.lit(False)).alias("ok"))


def retention(steps: DataFrame, step: str, id_col: str) -> DataFrame:
    return steps.groupBy(step).agg(F.countDistinct(id_col).alias("n_ids"))


def require_rows(df: DataFrame, step: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows left after {step}")
    return df
