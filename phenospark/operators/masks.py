"""Comparing two label images given as pixel rows (site, gt_id, pred_id); 0 is background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from phenospark.functions.scalar import safe_ratio

THRESHOLDS = (0.5, 0.7, 0.8, 0.9)


def contingency(pixels: DataFrame, site: Sequence[str]) -> DataFrame:
    """Pixel count of every label pair; the pixels themselves are reduced on the map side."""
    return pixels.groupBy(*site, "gt_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))


def overlaps(cells: DataFrame, site: Sequence[str]) -> DataFrame:
    """IoU and the shares of true and predicted area for each pair of objects that touch."""
    site = list(site)
    true = cells.groupBy(*site, "gt_id").agg(F.sum("n").alias("n_true_px"))
    pred = cells.groupBy(*site, "pred_id").agg(F.sum("n").alias("n_pred_px"))
    both = cells.filter("gt_id > 0 AND pred_id > 0").join(true, [*site, "gt_id"]).join(pred, [*site, "pred_id"])
    union = F.col("n_true_px") + F.col("n_pred_px") - F.col("n")
    return both.select(*site, "gt_id", "pred_id", "n", (F.col("n") / union).alias("iou"),
                       (F.col("n") / F.col("n_true_px")).alias("over_true"), (F.col("n") / F.col("n_pred_px")).alias("over_pred"))


def object_counts(cells: DataFrame, site: Sequence[str]) -> DataFrame:
    return cells.groupBy(*site).agg(
        F.countDistinct(F.when(F.col("gt_id") > 0, F.col("gt_id"))).alias("n_true"),
        F.countDistinct(F.when(F.col("pred_id") > 0, F.col("pred_id"))).alias("n_pred"))


def instance_scores(cells: DataFrame, site: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Matching scores per site and threshold (at least 0.5).

    Above 0.5 an object has at most one partner. At exactly 0.5 ties form stars of two pairs that share one object,
    of which one pair can match; weighing each pair by its shared object's pair count gives that without a solver.
    """
    if min(thresholds) < 0.5:
        raise ValueError("matches are unique only from 0.5 on")
    site = list(site)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    pairs = overlaps(cells, site).select("*", levels).filter("iou >= threshold")
    by_true = pairs.groupBy(*site, "threshold", "gt_id").agg(F.count(F.lit(1)).alias("_dt"))
    by_pred = pairs.groupBy(*site, "threshold", "pred_id").agg(F.count(F.lit(1)).alias("_dp"))
    weighed = (pairs.join(by_true, [*site, "threshold", "gt_id"]).join(by_pred, [*site, "threshold", "pred_id"])
               .withColumn("_w", 1 / F.greatest("_dt", "_dp")))
    hits = weighed.groupBy(*site, "threshold").agg(
        F.round(F.sum("_w")).cast("bigint").alias("tp"), F.sum(F.col("_w") * F.col("iou")).alias("_sum"))
    grid = object_counts(cells, site).select("*", levels)
    s = grid.join(hits, [*site, "threshold"], "left").fillna(0, ["tp"]).fillna(0.0, ["_sum"])
    tp, true, pred = F.col("tp"), F.col("n_true"), F.col("n_pred")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        *site, "threshold", "n_true", "n_pred", "tp", (pred - tp).alias("fp"), (true - tp).alias("fn"),
        zero(safe_ratio(tp, pred)).alias("precision"), zero(safe_ratio(tp, true)).alias("recall"),
        zero(safe_ratio(2 * tp, true + pred)).alias("f1"), zero(safe_ratio(tp, true + pred - tp)).alias("accuracy"),
        zero(safe_ratio(F.col("_sum"), true)).alias("mean_true_score"),
        zero(safe_ratio(F.col("_sum"), tp)).alias("mean_matched_score"),
        zero(safe_ratio(2 * F.col("_sum"), true + pred)).alias("panoptic_quality"))


def foreground_scores(cells: DataFrame, site: Sequence[str]) -> DataFrame:
    """Dice, IoU, precision and recall of object pixels against background."""
    t, p = F.col("gt_id") > 0, F.col("pred_id") > 0
    area = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    s = cells.groupBy(*site).agg(area(t & p).alias("_b"), area(t).alias("_t"), area(p).alias("_p"))
    b, nt, np_ = F.col("_b"), F.col("_t"), F.col("_p")
    return s.select(*site, safe_ratio(2 * b, nt + np_).alias("dice"), safe_ratio(b, nt + np_ - b).alias("iou"),
                    safe_ratio(b, np_).alias("precision"), safe_ratio(b, nt).alias("recall"))


def instance_mapping(cells: DataFrame, site: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Matched pairs (TP) and the ids left over on either side (FN, FP); a tie keeps its smallest pair."""
    site = list(site)
    pairs = overlaps(cells, site).filter(F.col("iou") >= threshold)
    per_true = pairs.groupBy(*site, "gt_id").agg(F.min(F.struct("pred_id", "iou")).alias("_m"))
    tp = (per_true.select(*site, "gt_id", F.col("_m.pred_id").alias("pred_id"), F.col("_m.iou").alias("iou"))
          .groupBy(*site, "pred_id").agg(F.min(F.struct("gt_id", "iou")).alias("_m"))
          .select(*site, F.col("_m.gt_id").alias("gt_id"), "pred_id", F.col("_m.iou").alias("iou"), F.lit("TP").alias("match_type")))
    none = F.lit(None).cast("bigint")
    fn = (cells.filter("gt_id > 0").select(*site, "gt_id").distinct().join(tp, [*site, "gt_id"], "left_anti")
          .select(*site, "gt_id", none.alias("pred_id"), F.lit(None).cast("double").alias("iou"), F.lit("FN").alias("match_type")))
    fp = (cells.filter("pred_id > 0").select(*site, "pred_id").distinct().join(tp, [*site, "pred_id"], "left_anti")
          .select(*site, none.alias("gt_id"), "pred_id", F.lit(None).cast("double").alias("iou"), F.lit("FP").alias("match_type")))
    return tp.unionByName(fn).unionByName(fp)


def sample_picks(scores: DataFrame, id_col: str, score: str) -> DataFrame:
    """The worst, median and best sample: three rows found by running counts, not by one sorted partition."""
    from phenospark.operators.ordered import ordinal_rank

    total = scores.agg(F.count(F.lit(1))).scalar()
    ranked = ordinal_rank(scores.select(id_col, score, F.lit(0).alias("_all")), ["_all"], score, id_col, "_rn").drop("_all")
    pick = (F.when(F.col("_rn") == 1, "worst").when(F.col("_rn") == F.col("_n"), "best")
            .when(F.col("_rn") == F.floor(F.col("_n") / 2) + 1, "median"))
    return (ranked.withColumn("_n", total).withColumn("pick", pick).filter(F.col("pick").isNotNull())
            .drop("_rn", "_n"))
