"""Paired comparison, label masks and release checks."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import aggregate as ag
from phenospark.operators import masks as mk
from phenospark.operators import quality as ql
from phenospark.operators import stats as st
from phenospark.operators.frame import ProfileFrame

# Two variants of the same objects: lineitem columns and a disturbed copy, per return flag.
PAIR_SQL = """pr AS (SELECT l_returnflag AS codec, l_suppkey AS site, l_partkey AS obj, 'q' AS feature, l_quantity AS a, l_quantity + l_discount * 100 AS b FROM lineitem
   UNION ALL SELECT l_returnflag, l_suppkey, l_partkey, 'p', l_extendedprice, l_extendedprice * (1 + l_tax) FROM lineitem
   UNION ALL SELECT l_returnflag, l_suppkey, l_partkey, 'c', CASE WHEN l_linenumber <> 3 THEN 1.0 END, l_tax FROM lineitem)"""


def pairs(t):
    li = t.lineitem.select(
        F.col("l_returnflag").alias("codec"), F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("obj"),
        F.col("l_quantity").alias("q_a"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("q_b"),
        F.col("l_extendedprice").alias("p_a"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("p_b"),
        F.when(F.col("l_linenumber") != 3, F.lit(1.0)).alias("c_a"), F.col("l_tax").alias("c_b"))
    return st.paired_long(li, ["codec", "site", "obj"], ["q", "p", "c"])


CORR = "CASE WHEN count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) >= 2 AND max(a) > min(a) AND max(b) > min(b) THEN corr(a, b) END"


@query("sta_01_feature_correlation", f"WITH {PAIR_SQL} SELECT codec, feature, round({CORR}, 6) AS r, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n FROM pr GROUP BY ALL")
def _(t):
    return st.feature_correlations(pairs(t), ["codec", "feature"]).withColumn("r", r6("r"))


DIAG_SQL = f"""{PAIR_SQL}, ok AS (SELECT codec, feature, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS b FROM pr),
  dg AS (SELECT codec, feature, count(a) AS n_valid, 1 - count(a)::DOUBLE / count(*) AS nan_rate, avg(a) AS a_mean, avg(b) AS b_mean, stddev_pop(a) AS a_std, stddev_pop(b) AS b_std,
    var_pop(a) AS a_var, var_pop(b) AS b_var, covar_pop(a, b) AS covariance, median(a) AS a_median, median(b) AS b_median, {CORR} AS r FROM ok GROUP BY ALL)"""


@query("sta_02_pair_diagnostics", f"""WITH {DIAG_SQL} SELECT codec, feature, n_valid, round(nan_rate, 6) AS nan_rate, round(a_mean, 4) AS a_mean, round(b_mean, 4) AS b_mean, round(a_std, 4) AS a_std,
  round(b_std, 4) AS b_std, round(a_median, 6) AS a_median, round(b_median, 6) AS b_median FROM dg""")
def _(t):
    d = st.pair_diagnostics(pairs(t), ["codec", "feature"])
    return d.select("codec", "feature", "n_valid", r6("nan_rate").alias("nan_rate"), *[r6(c, 4).alias(c) for c in ("a_mean", "b_mean", "a_std", "b_std")],
                    r6("a_median").alias("a_median"), r6("b_median").alias("b_median"))


SITE_SQL = f"{PAIR_SQL}, sm AS (SELECT codec, feature, site, median(a) AS a, median(b) AS b FROM pr GROUP BY ALL)"


def site_rows(t):
    return st.site_level(pairs(t), ["codec", "feature", "site"], "a", "b")


@query("sta_03_site_level_correlation", f"WITH {SITE_SQL} SELECT codec, feature, round({CORR}, 6) AS r, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n FROM sm GROUP BY ALL")
def _(t):
    return st.feature_correlations(site_rows(t), ["codec", "feature"]).withColumn("r", r6("r"))


@query("sta_04_reference_variant", """
  WITH w AS (SELECT c_nationkey AS site, c_mktsegment AS codec, avg(c_acctbal) AS v FROM customer GROUP BY ALL)
  SELECT b.codec, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM w a JOIN w b USING (site) WHERE a.codec = 'BUILDING' AND b.codec <> 'BUILDING' GROUP BY b.codec""")
def _(t):
    w = t.customer.groupBy(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("codec")).agg(F.avg("c_acctbal").alias("v"))
    ref = w.filter("codec = 'BUILDING'").select("site", F.col("v").alias("a"))
    both = w.filter("codec <> 'BUILDING'").withColumnRenamed("v", "b").join(ref, "site")
    return st.feature_correlations(both, ["codec"]).withColumn("r", r6("r"))


def spearman_sql(src, keys, min_n):
    part = ", ".join(keys)
    rank = lambda c: f"rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0::DOUBLE"
    return (f"rk AS (SELECT {part}, {rank('a')} AS ra, {rank('b')} AS rb FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL) "
            f"SELECT {part}, round(CASE WHEN count(*) >= {min_n} AND max(ra) > min(ra) AND max(rb) > min(rb) THEN corr(ra, rb) END, 6) AS rho, count(*) AS n FROM rk GROUP BY {part}")


@query("sta_05_profile_spearman", f"WITH {PAIR_SQL}, " + spearman_sql("pr", ["codec", "site"], 3))
def _(t):
    return st.spearman(pairs(t), ["codec", "site"]).withColumn("rho", r6("rho"))


@query("sta_06_replicate_spearman", f"WITH {SITE_SQL}, " + spearman_sql("sm", ["codec", "feature"], 5))
def _(t):
    return st.spearman(site_rows(t), ["codec", "feature"], min_n=5).withColumn("rho", r6("rho"))


DIST_SQL = """d AS (SELECT l_linenumber AS feature, l_quantity + l_tax AS v, l_returnflag = 'A' AS is_a FROM lineitem),
  cn AS (SELECT feature, v, count(*) FILTER (WHERE is_a) AS ca, count(*) FILTER (WHERE NOT is_a) AS cb FROM d GROUP BY ALL),
  cm AS (SELECT feature, v, sum(ca) OVER w::DOUBLE / sum(ca) OVER p AS fa, sum(cb) OVER w::DOUBLE / sum(cb) OVER p AS fb, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nx FROM cn
    WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
  ds AS (SELECT feature, max(abs(fa - fb)) AS ks, sum(abs(fa - fb) * coalesce(nx - v, 0)) AS w1 FROM cm GROUP BY feature),
  ef AS (SELECT feature, avg(v) FILTER (WHERE is_a) AS ma, avg(v) FILTER (WHERE NOT is_a) AS mb, var_samp(v) FILTER (WHERE is_a) AS va, var_samp(v) FILTER (WHERE NOT is_a) AS vb FROM d GROUP BY feature)"""
DIST_SQL = DIST_SQL.replace("sum(ca) OVER w::DOUBLE", "(sum(ca) OVER w)::DOUBLE").replace("sum(cb) OVER w::DOUBLE", "(sum(cb) OVER w)::DOUBLE").replace("/ sum(ca) OVER p", "/ (sum(ca) OVER p)").replace("/ sum(cb) OVER p", "/ (sum(cb) OVER p)")


def two_samples(t):
    return t.lineitem.select(F.col("l_linenumber").alias("feature"), (F.col("l_quantity") + F.col("l_tax")).alias("v"), (F.col("l_returnflag") == "A").alias("is_a"))


@query("sta_07_distribution_distances", f"WITH {DIST_SQL} SELECT feature, round(ks, 6) AS ks FROM ds")
def _(t):
    return st.distribution_distances(two_samples(t), ["feature"], "v", "is_a").select("feature", r6("ks").alias("ks"))


@query("sta_08_cohens_d", f"WITH {DIST_SQL} SELECT feature, round(abs(ma - mb) / sqrt((va + vb) / 2), 6) AS cohens_d FROM ef")
def _(t):
    return st.effect_sizes(two_samples(t), ["feature"], "v", "is_a").select("feature", r6("cohens_d").alias("cohens_d"))


@query("sta_09_wasserstein", f"WITH {DIST_SQL} SELECT feature, round(w1, 6) AS wasserstein, round(w1 / sqrt((va + vb) / 2), 6) AS wasserstein_scaled FROM ds JOIN ef USING (feature)")
def _(t):
    d = st.distribution_distances(two_samples(t), ["feature"], "v", "is_a")
    return d.select("feature", r6("wasserstein").alias("wasserstein"), r6("wasserstein_scaled").alias("wasserstein_scaled"))


@query("sta_10_variance_ratio", f"WITH {DIST_SQL} SELECT feature, round(least(greatest(va, vb) / least(va, vb), 100), 6) AS variance_ratio FROM ef")
def _(t):
    return st.effect_sizes(two_samples(t), ["feature"], "v", "is_a").select("feature", r6("variance_ratio").alias("variance_ratio"))


@query("sta_11_replicate_pairs", """WITH {profiles}, r AS (SELECT plate, well AS treatment, compound AS w, row_number() OVER (PARTITION BY plate, well ORDER BY compound) AS rn FROM (SELECT DISTINCT plate, well, compound FROM profiles))
  SELECT a.plate, a.treatment, a.w AS well_a, b.w AS well_b FROM r a JOIN r b ON a.plate = b.plate AND a.treatment = b.treatment AND a.rn = 1 AND b.rn = 2""")
def _(t):
    rows = t.profiles.select("plate", F.col("well").alias("treatment"), F.col("compound").alias("w"))
    return st.replicate_pairs(rows, "plate", "treatment", "w")


@query("sta_12_delta_to_reference", """WITH {runs} SELECT a.family, a.config, a.codec, round(a.pa - b.pa, 6) AS delta_pa, round(a.pc - b.pc, 6) AS delta_pc FROM runs a JOIN runs b
  ON a.family = b.family AND a.config = b.config WHERE b.codec = 'codec0' AND a.codec <> 'codec0'""")
def _(t):
    d = st.delta_to_reference(t.runs, ["family", "config"], "codec", "codec0", ["pa", "pc"])
    return d.select("family", "config", "codec", r6("delta_pa").alias("delta_pa"), r6("delta_pc").alias("delta_pc"))


def _cos_sql():
    feats = ["f0", "f1", "f2", "f3"]
    cells = " UNION ALL ".join(f"SELECT '{a}' AS feature, sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})) AS c FROM profiles" for a in feats for b in feats if a != b)
    return f"WITH {{profiles}}, c AS ({cells}) SELECT feature, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(max(c), 6) AS max, round(min(c), 6) AS min FROM c GROUP BY feature"


@query("sta_13_feature_cosines", _cos_sql())
def _(t):
    d = st.cosine_between_features(ProfileFrame.from_wide(t.profiles, ["f0", "f1", "f2", "f3"]))
    return d.select("feature", *[r6(c).alias(c) for c in ("mean", "std", "max", "min")])


@query("sta_16_match_rate", """WITH {masks} SELECT site, count(DISTINCT gt_id) FILTER (WHERE gt_id > 0) AS n_total, count(DISTINCT gt_id) FILTER (WHERE gt_id > 0 AND gt_id = pred_id) AS n_matched,
  round(count(DISTINCT gt_id) FILTER (WHERE gt_id > 0 AND gt_id = pred_id)::DOUBLE / count(DISTINCT gt_id) FILTER (WHERE gt_id > 0), 6) AS rate FROM masks GROUP BY site""")
def _(t):
    real = F.col("gt_id") > 0
    s = t.masks.groupBy("site").agg(F.countDistinct(F.when(real, F.col("gt_id"))).alias("n_total"),
                                    F.countDistinct(F.when(real & (F.col("gt_id") == F.col("pred_id")), F.col("gt_id"))).alias("n_matched"))
    return s.withColumn("rate", r6(st.match_rate(F.col("n_matched"), F.col("n_total"))))


def beta_series_sql(a: str, b: str, x: str) -> str:
    """Incomplete beta function by its power series, for x below its mean."""
    return (f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / ({a}) * (1 + list_sum(list_transform(range(0, 5000), lambda k: "
            f"exp(lgamma({a} + {b} + k + 1) - lgamma({a} + {b}) - lgamma({a} + k + 2) + lgamma({a} + 1) + (k + 1) * ln({x})))))")


RHO_SQL = spearman_sql("sm", ["codec", "feature"], 5).replace("round(CASE", "(CASE").replace("END, 6) AS rho", "END) AS rho").replace(") SELECT", "), rh AS (SELECT") + ")"


@query("sta_17_rank_p_values", f"""WITH {SITE_SQL}, {RHO_SQL}, x AS (SELECT *, (n - 2) / 2.0::DOUBLE AS h, 1 - rho * rho AS x FROM rh)
  SELECT codec, feature, round(rho, 6) AS rho, n, round(CASE WHEN rho IS NULL OR n < 3 THEN NULL WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1
    WHEN x < (h + 1) / (h + 2.5) THEN {beta_series_sql("h", "0.5::DOUBLE", "x")} ELSE 1 - {beta_series_sql("0.5::DOUBLE", "h", "(1 - x)")} END, 6) AS p_value FROM x""")
def _(t):
    """Spearman correlations with two-sided p-values; SQL adds up another series for the tail."""
    out = st.spearman_test(site_rows(t), ["codec", "feature"], min_n=5)
    return out.select("codec", "feature", r6("rho").alias("rho"), "n", r6("p_value").alias("p_value"))


@query("sta_18_low_correlation_cause", f"""WITH {DIAG_SQL} SELECT codec, feature, CASE WHEN abs(coalesce(r, 0)) < 0.5 THEN CASE WHEN least(a_std, b_std) < 1e-10 THEN 'constant' WHEN least(a_std, b_std) < 1e-6 THEN 'near-constant'
  WHEN abs(a_mean - b_mean) / greatest(a_std, 1e-10) > 3 THEN 'mean shift' WHEN nan_rate * 100 > 5 THEN 'high missing rate' WHEN abs(covariance) < sqrt(a_var * b_var) * 0.01 THEN 'no covariance' ELSE 'unexplained' END END AS cause FROM dg""")
def _(t):
    keys = ["codec", "feature"]
    d = st.pair_diagnostics(pairs(t), keys).join(st.feature_correlations(pairs(t), keys), keys)
    return d.select(*keys, st.low_correlation_cause(F.coalesce("r", F.lit(0.0)), 0.5).alias("cause"))


@query("sta_19_object_vs_site", f"""WITH {SITE_SQL}, o AS (SELECT codec, feature, {CORR} AS r FROM pr GROUP BY ALL), s AS (SELECT codec, feature, {CORR} AS r FROM sm GROUP BY ALL)
  SELECT codec, count(*) AS n, round(avg(o.r - s.r), 6) AS mean_difference FROM o JOIN s USING (codec, feature) WHERE o.r IS NOT NULL AND s.r IS NOT NULL GROUP BY codec""")
def _(t):
    keys = ["codec", "feature"]
    obj = st.feature_correlations(pairs(t), keys).select(*keys, F.col("r").alias("ro"))
    site = st.feature_correlations(site_rows(t), keys).select(*keys, F.col("r").alias("rs"))
    both = obj.join(site, keys).dropna(subset=["ro", "rs"])
    return both.groupBy("codec").agg(F.count("*").alias("n"), r6(F.avg(F.col("ro") - F.col("rs"))).alias("mean_difference"))


@query("sta_20_noise_order", f"""WITH {DIAG_SQL} SELECT codec, feature, round(r, 6) AS r, round(a_std / a_mean, 6) AS noise FROM dg WHERE abs(a_std / a_mean) <= 0.6""")
def _(t):
    keys = ["codec", "feature"]
    d = st.pair_diagnostics(pairs(t), keys).join(st.feature_correlations(pairs(t), keys), keys)
    noise = F.col("a_std") / F.col("a_mean")
    return d.filter(F.abs(noise) <= 0.6).select(*keys, r6("r").alias("r"), r6(noise).alias("noise")).orderBy("noise")


@query("sta_21_restrict_by_reference", f"""WITH {PAIR_SQL}, o AS (SELECT codec, feature, {CORR} AS r FROM pr GROUP BY ALL)
  SELECT codec, feature, round(r, 6) AS r FROM o WHERE feature IN (SELECT feature FROM o WHERE codec = 'A' AND r > 0.75) AND feature <> 'c'""")
def _(t):
    o = st.feature_correlations(pairs(t), ["codec", "feature"])
    good = o.filter("codec = 'A' AND r > 0.75").select("feature")
    return o.join(good, "feature", "left_semi").filter("feature <> 'c'").select("codec", "feature", r6("r").alias("r"))


# ---- label masks -------------------------------------------------------------------------------------

CELLS_SQL = "cl AS (SELECT site, gt_id, pred_id, count(*) AS n FROM masks GROUP BY ALL)"
OVER_SQL = f"""{CELLS_SQL}, ov AS (SELECT c.site, c.gt_id, c.pred_id, c.n, t.n AS nt, p.n AS np, c.n::DOUBLE / (t.n + p.n - c.n) AS iou FROM cl c
   JOIN (SELECT site, gt_id, CAST(sum(n) AS BIGINT) AS n FROM cl GROUP BY ALL) t ON t.site = c.site AND t.gt_id = c.gt_id
   JOIN (SELECT site, pred_id, CAST(sum(n) AS BIGINT) AS n FROM cl GROUP BY ALL) p ON p.site = c.site AND p.pred_id = c.pred_id WHERE c.gt_id > 0 AND c.pred_id > 0)"""


def cells(t):
    return mk.contingency(t.masks, ["site"])


@query("msk_01_contingency", f"WITH {{masks}}, {CELLS_SQL} SELECT * FROM cl")
def _(t):
    return cells(t)


@query("msk_02_overlaps", f"WITH {{masks}}, {OVER_SQL} SELECT site, gt_id, pred_id, n, round(iou, 6) AS iou, round(n::DOUBLE / nt, 6) AS over_true, round(n::DOUBLE / np, 6) AS over_pred FROM ov")
def _(t):
    return mk.overlaps(cells(t), ["site"]).withColumns({c: r6(c) for c in ("iou", "over_true", "over_pred")})


@query("msk_03_instance_scores", f"""WITH {{masks}}, {OVER_SQL}, k AS (SELECT site, count(DISTINCT gt_id) FILTER (WHERE gt_id > 0) AS n_true, count(DISTINCT pred_id) FILTER (WHERE pred_id > 0) AS n_pred FROM cl GROUP BY site),
  th AS (SELECT unnest([0.5, 0.7, 0.8, 0.9])::DOUBLE AS threshold), m AS (SELECT site, threshold, gt_id, pred_id, iou, greatest(count(*) OVER (PARTITION BY site, threshold, gt_id), count(*) OVER (PARTITION BY site, threshold, pred_id)) AS d FROM ov, th WHERE iou >= threshold),
  h AS (SELECT site, threshold, CAST(round(sum(1.0::DOUBLE / d)) AS BIGINT) AS tp, sum(iou / d) AS s FROM m GROUP BY ALL), g AS (SELECT k.*, threshold, coalesce(tp, 0) AS tp, coalesce(s, 0) AS s FROM k CROSS JOIN th LEFT JOIN h USING (site, threshold))
  SELECT site, threshold, n_true, n_pred, tp, n_pred - tp AS fp, n_true - tp AS fn, round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(n_true, 0), 0), 6) AS recall,
   round(coalesce(2.0::DOUBLE * tp / nullif(n_true + n_pred, 0), 0), 6) AS f1, round(coalesce(tp::DOUBLE / nullif(n_true + n_pred - tp, 0), 0), 6) AS accuracy, round(coalesce(2 * s / nullif(n_true + n_pred, 0), 0), 6) AS panoptic_quality FROM g""")
def _(t):
    s = mk.instance_scores(cells(t), ["site"])
    return s.select("site", "threshold", "n_true", "n_pred", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy", "panoptic_quality")])


@query("msk_04_foreground_scores", """WITH {masks}, s AS (SELECT site, count(*) FILTER (WHERE gt_id > 0 AND pred_id > 0)::DOUBLE AS b, count(*) FILTER (WHERE gt_id > 0) AS t, count(*) FILTER (WHERE pred_id > 0) AS p FROM masks GROUP BY site)
  SELECT site, round(2 * b / (t + p), 6) AS dice, round(b / (t + p - b), 6) AS iou, round(b / p, 6) AS precision, round(b / t, 6) AS recall FROM s""")
def _(t):
    return mk.foreground_scores(cells(t), ["site"]).select("site", *[r6(c).alias(c) for c in ("dice", "iou", "precision", "recall")])


@query("msk_05_instance_mapping", f"""WITH {{masks}}, {OVER_SQL}, tp AS (SELECT site, gt_id, pred_id, iou FROM ov WHERE iou >= 0.6)
  SELECT site, gt_id, pred_id, round(iou, 6) AS iou, 'TP' AS match_type FROM tp
  UNION ALL SELECT DISTINCT site, gt_id, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 'FN' FROM cl WHERE gt_id > 0 AND (site, gt_id) NOT IN (SELECT (site, gt_id) FROM tp)
  UNION ALL SELECT DISTINCT site, CAST(NULL AS BIGINT), pred_id, CAST(NULL AS DOUBLE), 'FP' FROM cl WHERE pred_id > 0 AND (site, pred_id) NOT IN (SELECT (site, pred_id) FROM tp)""")
def _(t):
    return mk.instance_mapping(cells(t), ["site"], 0.6).withColumn("iou", r6("iou"))


@query("msk_06_file_pairing", "SELECT a.p_name AS name, a.p_partkey AS gt, b.p_partkey AS pred FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_type = 'PROMO' AND b.p_type = 'SMALL'")
def _(t):
    gt = t.part.filter("p_type = 'PROMO'").select("p_name", "p_size", F.col("p_partkey").alias("gt"))
    pred = t.part.filter("p_type = 'SMALL'").select("p_name", "p_size", F.col("p_partkey").alias("pred"))
    return gt.join(pred, ["p_name", "p_size"]).select(F.col("p_name").alias("name"), "gt", "pred")


@query("msk_07_count_difference", """WITH {masks}, k AS (SELECT site, count(DISTINCT gt_id) FILTER (WHERE gt_id > 0) AS t, count(DISTINCT pred_id) FILTER (WHERE pred_id > 0) AS p FROM masks GROUP BY site)
  SELECT round(avg(p - t), 6) AS mean, round(stddev_samp(p - t), 6) AS std, count(*) AS n FROM k""")
def _(t):
    diff = F.col("n_pred") - F.col("n_true")
    return mk.object_counts(cells(t), ["site"]).agg(r6(F.avg(diff)).alias("mean"), r6(F.stddev_samp(diff)).alias("std"), F.count("*").alias("n"))


# ---- release checks ----------------------------------------------------------------------------------

@query("val_01_bad_cells", """WITH {profiles}, {bad_profiles} SELECT CAST(sum(CASE WHEN isnan(f2) THEN 1 ELSE 0 END) AS BIGINT) AS n_nan, CAST(sum(CASE WHEN isinf(f1) THEN 1 ELSE 0 END) AS BIGINT) AS n_inf,
  CAST(sum(CASE WHEN f3 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, count(*) FILTER (WHERE isnan(f2) OR isinf(f1) OR f3 IS NULL) AS n_rows FROM bad_profiles""")
def _(t):
    return ql.invalid_cells(ProfileFrame.from_wide(t.bad_profiles, ["f0", "f1", "f2", "f3"]))


@query("val_02_leading_variance")
def _(t):
    pf = ProfileFrame(t.vectors, tuple(f"e{i}" for i in range(64)))
    first, second = ql.leading_variance(pf, 2)
    return t.vectors.agg(F.count("*").alias("n")).withColumns({"pc1": F.lit(first), "pc2": F.lit(second), "ok": F.lit(first <= 0.4)})


KEYS_SQL = "ks AS (SELECT 'v' || (o_custkey % 3) AS variant, 'k' || (o_orderkey % 3000) AS key FROM orders), cn AS (SELECT 'k' || p_partkey AS key FROM part)"


def variant_keys(t):
    keys = t.orders.select(F.concat(F.lit("v"), (F.col("o_custkey") % 3).cast("string")).alias("variant"), F.concat(F.lit("k"), (F.col("o_orderkey") % 3000).cast("string")).alias("key"))
    return keys, t.part.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"))


@query("val_03_variant_key_sets", f"""WITH {KEYS_SQL}, h AS (SELECT DISTINCT variant, key FROM ks), v AS (SELECT DISTINCT variant FROM ks)
  SELECT variant, (SELECT count(*) FROM h WHERE h.variant = v.variant) AS n_keys, (SELECT count(*) FROM cn WHERE key NOT IN (SELECT key FROM h WHERE h.variant = v.variant)) AS n_missing,
   (SELECT count(*) FROM h WHERE h.variant = v.variant AND key NOT IN (SELECT key FROM cn)) AS n_extra, false AS same_digest FROM v""")
def _(t):
    keys, canonical = variant_keys(t)
    return ql.compare_variants(keys, "variant", "key", canonical).withColumn("n_keys", F.col("n_keys").cast("bigint"))


@query("val_04_malformed_keys", "SELECT url FROM pages WHERE len(string_split(url, '/')) <> 5 OR list_contains(string_split(url, '/'), '')")
def _(t):
    return ql.malformed_keys(t.pages.select("url"), "url", 5, "/")


@query("val_05_expectations", """SELECT 'n_rows' AS rule, CAST(count(*) AS VARCHAR) AS observed, CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS expected, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders
  UNION ALL SELECT 'null_status', CAST(count(*) FILTER (WHERE o_orderstatus IS NULL) AS VARCHAR), '0', count(*) FILTER (WHERE o_orderstatus IS NULL) = 0 FROM orders
  UNION ALL SELECT 'orphans', CAST(count(*) AS VARCHAR), '0', count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    n = t.orders.select("o_orderkey").distinct().count()
    own = ql.expect(t.orders, [("n_rows", F.count(F.lit(1)), n), ("null_status", F.count_if(F.col("o_orderstatus").isNull()), 0)])
    orphans = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return own.unionByName(ql.expect(orphans, [("orphans", F.count(F.lit(1)), 0)]))


@query("val_06_inventory", """WITH a AS (SELECT DISTINCT c_mktsegment AS model, c_nationkey AS codec FROM customer), e AS (SELECT DISTINCT c_mktsegment AS model, s_nationkey AS codec FROM customer, supplier WHERE s_acctbal > 3000)
  SELECT model, codec, 'missing' AS status FROM e ANTI JOIN a USING (model, codec) UNION ALL SELECT model, codec, 'extra' FROM a ANTI JOIN e USING (model, codec)""")
def _(t):
    actual = t.customer.select(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("codec"))
    segments = t.customer.agg(F.collect_set("c_mktsegment").alias("models"))
    expected = (t.supplier.filter("s_acctbal > 3000").select(F.col("s_nationkey").alias("codec")).distinct()
                .join(F.broadcast(segments)).select(F.explode("models").alias("model"), "codec"))
    return ql.compare_inventory(actual, expected, ["model", "codec"])


@query("val_07_quarantine_plan", """WITH {site_index}, k AS (SELECT source || '__' || batch || '__' || plate || '__' || well || '__' || site AS key, site FROM site_index)
  SELECT key, 'quarantine/' || split_part(key, '__', 1) || '/' || key AS destination FROM k WHERE site NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    keys = t.site_index.select(F.concat_ws("__", "source", "batch", "plate", "well", "site").alias("key"), "site")
    used = keys.join(t.lineitem.select(F.col("l_orderkey").alias("site")), "site", "left_semi").select("key")
    return ql.quarantine_plan(keys.select("key"), used, "key")


@query("val_08_index_manifest", """WITH {site_index} SELECT 'sites' AS name, count(*) AS n FROM site_index UNION ALL SELECT 'plates', count(*) FROM (SELECT DISTINCT source, batch, plate FROM site_index)
  UNION ALL SELECT 'images', count("URL_DNA") + count("URL_RNA") FROM site_index""")
def _(t):
    from phenospark.operators.reshape import unpivot

    idx = t.site_index
    images = unpivot(idx, ["site"], ["URL_DNA", "URL_RNA"], "channel", "uri")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return count(idx, "sites").unionByName(count(idx.select("source", "batch", "plate").distinct(), "plates")).unionByName(count(images, "images"))


@query("val_09_empty_step", "SELECT count(*) AS n, true AS stopped FROM orders WHERE o_totalprice > 1000")
def _(t):
    kept = ql.require_rows(t.orders.filter("o_totalprice > 1000"), "price filter")
    try:
        ql.require_rows(t.orders.filter("o_totalprice < 0"), "empty filter")
        stopped = False
    except ValueError:
        stopped = True
    return kept.agg(F.count("*").alias("n")).withColumn("stopped", F.lit(stopped))


@query("val_10_retention", "SELECT 'all' AS step, count(DISTINCT o_custkey) AS n_ids FROM orders UNION ALL SELECT 'urgent', count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    step = lambda df, s: df.select(F.lit(s).alias("step"), "o_custkey")
    return ql.retention(step(t.orders, "all").unionByName(step(t.orders.filter("o_orderpriority = '1-URGENT'"), "urgent")), "step", "o_custkey")


@query("val_11_index_digest", "SELECT count(*) AS n, true AS ok FROM orders")
def _(t):
    """The digest of an index equals that of the same keys in another order and partitioning."""
    found = ag.set_digest(t.orders.orderBy(F.col("o_totalprice").desc()), F.col("o_orderkey").cast("string")).first()
    return ql.check_digest(t.orders, F.col("o_orderkey").cast("string"), found["n"], found["digest"]).select("n", "ok")


@query("val_12_file_checksums")
def _(t):
    """Stored files against a manifest made from them, with one entry that names a file that does not exist."""
    from phenospark.session import scratch_path
    from phenospark.sources.io import save_profiles

    path = scratch_path(t.spark, "files")
    save_profiles(t.customer, path)
    files = ql.file_checksums(t.spark, path, "*.parquet")
    manifest = files.select("name", "length", "md5")
    absent = manifest.limit(1).withColumn("name", F.lit("absent.parquet"))
    return ql.check_files(files, manifest.unionByName(absent))
