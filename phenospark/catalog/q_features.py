"""Feature selection and normalization."""

from pyspark.sql import functions as F

from phenospark.catalog.base import normal_quantile_sql, query, r6
from phenospark.operators import normalize as nm
from phenospark.operators import relational as rel
from phenospark.operators import select as sel
from phenospark.operators.frame import ProfileFrame

FEATS = ["f0", "f1", "f2", "f3"]


def frame(t) -> ProfileFrame:
    return ProfileFrame.from_wide(t.profiles, FEATS)


def bad_frame(t) -> ProfileFrame:
    return ProfileFrame.from_wide(t.bad_profiles, FEATS)


def named(df, pf):
    """Feature names for positions."""
    names = F.array(*[F.lit(n) for n in pf.names])
    return df.withColumn("feature", F.get(names, F.col("idx"))).drop("idx")


def out_wide(pf, digits=5):
    return pf.wide().select("row_id", *[r6(n, digits).alias(n) for n in pf.names])


def kept_names(t, names):
    """Names as rows, each with the number of profiles they apply to."""
    return t.profiles.agg(F.count("*").alias("n_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows")


@query("fsl_01_drop_na_columns", """WITH {profiles}, {bad_profiles}, {bad_long}
  SELECT feature, round(avg(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1.0 ELSE 0.0 END), 6) AS bad,
   avg(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1.0 ELSE 0.0 END) <= 0.05 AS keep FROM bad_long GROUP BY feature""")
def _(t):
    pf = bad_frame(t)
    kept = sel.drop_na_columns(pf, 0.05)
    return named(sel.bad_share(pf), pf).select("feature", r6("bad").alias("bad"), F.col("feature").isin(kept).alias("keep"))


@query("fsl_02_variance_threshold", """WITH {profiles}, {bad_profiles}, {bad_long},
  x AS (SELECT feature, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS v FROM bad_long),
  c AS (SELECT feature, v, count(*) AS c FROM x WHERE v IS NOT NULL GROUP BY ALL),
  r AS (SELECT feature, c, row_number() OVER (PARTITION BY feature ORDER BY c DESC) AS rn FROM c),
  top AS (SELECT feature, max(c) AS first, min(c) AS second FROM r WHERE rn <= 2 GROUP BY feature),
  s AS (SELECT feature, round(var_pop(v), 5) AS variance, count(*) AS n FROM x GROUP BY feature),
  u AS (SELECT feature, count(*) AS n_unique FROM c GROUP BY feature)
  SELECT feature, variance, n, n_unique, first, second, n_unique * 1.0 / n >= 0.01 AND second * 1.0 / first >= 0.05 AND variance >= 0.001 AS keep
  FROM s JOIN u USING (feature) JOIN top USING (feature)""")
def _(t):
    pf = bad_frame(t)
    rule = sel.variance_rule(0.05, 0.01, 0.001)
    return named(sel.variance_statistics(pf), pf).select(
        "feature", r6("variance", 5).alias("variance"), "n", "n_unique", "first", "second", rule.alias("keep"))


@query("fsl_03_correlation_threshold", """WITH {profiles}
  SELECT 'f0' AS a, 'f1' AS b, round(corr(f0, f1), 6) AS r FROM profiles UNION ALL SELECT 'f0', 'f2', round(corr(f0, f2), 6) FROM profiles
  UNION ALL SELECT 'f0', 'f3', round(corr(f0, f3), 6) FROM profiles UNION ALL SELECT 'f1', 'f2', round(corr(f1, f2), 6) FROM profiles
  UNION ALL SELECT 'f1', 'f3', round(corr(f1, f3), 6) FROM profiles UNION ALL SELECT 'f2', 'f3', round(corr(f2, f3), 6) FROM profiles""")
def _(t):
    from phenospark.operators.linalg import global_moments

    pf = frame(t)
    c = global_moments(pf).corr()
    rows = [(pf.names[i], pf.names[j], round(float(c[i, j]), 6)) for i in range(4) for j in range(i + 1, 4)]
    return t.spark.createDataFrame(rows, "a string, b string, r double")


@query("fsl_04_drop_outliers", """WITH {profiles}, {plong}, s AS (SELECT feature, (max(v) - avg(v)) / (stddev_pop(v) + 1e-8) AS z_max,
   (min(v) - avg(v)) / (stddev_pop(v) + 1e-8) AS z_min FROM plong GROUP BY feature)
  SELECT feature, round(z_max, 5) AS z_max, round(z_min, 5) AS z_min, abs(z_max) <= 1.8 AND abs(z_min) <= 1.8 AS keep FROM s""")
def _(t):
    pf = frame(t)
    kept = sel.drop_outliers(pf, 1.8)
    return named(sel.outlier_statistics(pf), pf).select(
        "feature", r6("z_max", 5).alias("z_max"), r6("z_min", 5).alias("z_min"), F.col("feature").isin(kept).alias("keep"))


COLUMNS = ["Cells_Area", "Cells_Location_Center_X", "Nuclei_ExecutionTime", "Cells_Texture_Entropy"]


def long_names(t):
    """The four features under measurement names, to select by name on whole profiles."""
    return ProfileFrame(frame(t).df, tuple(COLUMNS))


@query("fsl_05_blocklist", """WITH {profiles}
  SELECT row_id, round(f0, 5) AS "Cells_Area", round(f3, 5) AS "Cells_Texture_Entropy" FROM profiles""")
def _(t):
    pf = long_names(t)
    return out_wide(pf.select(sel.blocklist(pf.names)))


@query("fsl_06_include_exclude", """WITH {profiles} SELECT row_id, round(f0, 5) AS "Cells_Area" FROM profiles""")
def _(t):
    pf = long_names(t)
    return out_wide(pf.select(sel.exclude(sel.include(pf.names, ["Cells_"]), ["Location", "Texture"])))


@query("fsl_07_listed_features", """WITH {profiles} SELECT row_id, round(f1, 5) AS f1, round(f3, 5) AS f3 FROM profiles""")
def _(t):
    # The list is derived from the tables: features f1 and f3 are named by regions 1 and 3.
    listed = t.region.filter("r_regionkey % 2 = 1").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("feature"))
    pf = frame(t)
    return out_wide(pf.select(sel.include_listed(pf.names, listed)))


@query("fsl_08_filter_chain", """WITH {profiles}, {bad_profiles} SELECT row_id, round(f0, 5) AS f0 FROM bad_profiles""")
def _(t):
    steps = [("drop_na_columns", {"cutoff": 0.05}), ("drop_outliers", {"cutoff": 1.8}), ("exclude", {"patterns": ["f"]}),
             ("include", {"patterns": ["f0"]})]
    return out_wide(sel.filter_features(bad_frame(t), steps))


@query("fsl_09_prune_correlated", """WITH {profiles} SELECT row_id, round(f0, 5) AS f0, round(f1, 5) AS f1, round(f2, 5) AS f2, round(f3, 5) AS f3 FROM profiles""")
def _(t):
    # A copy of f0 is linked to it with correlation one; the greedy choice keeps the first of the two.
    pf = ProfileFrame.from_wide(t.profiles.withColumn("f4", F.col("f0") * 2 + 1), [*FEATS, "f4"])
    return out_wide(pf.select(sel.correlation_threshold(pf, 0.999)))


@query("fsl_10_replicate_lists", """
  WITH c AS (SELECT p_brand AS feature, round(avg(p_size) / 50, 6) AS r FROM part GROUP BY 1)
  SELECT feature, r, CASE WHEN r >= 0.52 THEN 'green' ELSE 'red' END AS list FROM c WHERE r >= 0.52 OR r < 0.48""")
def _(t):
    from phenospark.operators.stats import replicate_lists

    scores = t.part.groupBy(F.col("p_brand").alias("feature")).agg(r6(F.avg("p_size") / 50).alias("r"))
    return replicate_lists(scores, "r", 0.52, 0.48)


@query("fsl_11_name_redlist", "SELECT p_partkey, p_name FROM part WHERE NOT (contains(p_name, 'red') OR contains(p_name, 'ring'))")
def _(t):
    return t.part.filter(~(F.col("p_name").contains("red") | F.col("p_name").contains("ring"))).select("p_partkey", "p_name")


@query("fsl_12_drop_sparse_then_rows", """WITH {profiles}, {bad_profiles}
  SELECT row_id, round(f0, 5) AS f0, round(f1, 5) AS f1, round(f2, 5) AS f2 FROM bad_profiles
  WHERE NOT isinf(f1) AND NOT isnan(f2)""")
def _(t):
    pf = bad_frame(t)
    return out_wide(sel.clean_rows(pf.select(["f0", "f1", "f2"]), 0.30))


@query("prj_08_clean_nans", """WITH {profiles}, {bad_profiles}
  SELECT row_id, round(f0, 5) AS f0, round(f1, 5) AS f1, round(f2, 5) AS f2, round(f3, 5) AS f3 FROM bad_profiles
  WHERE NOT isinf(f1) AND NOT isnan(f2) AND f3 IS NOT NULL""")
def _(t):
    return out_wide(sel.clean_rows(bad_frame(t), 0.30))


# ---- normalization -----------------------------------------------------------------------------------

def scaled(stat_center, stat_scale, table="profiles", where="negcon", batch="plate", digits=5):
    """SQL of (x - centre) / scale for each feature, with statistics from the rows under a condition."""
    stats = ", ".join(f"{stat_center.format(c=c)} AS c_{c}, {stat_scale.format(c=c)} AS s_{c}" for c in FEATS)
    cols = ", ".join(f"round((p.{c} - s.c_{c}) / (s.s_{c} + 1e-18), {digits}) AS {c}" for c in FEATS)
    return (f"s AS (SELECT {batch}, {stats} FROM {table} WHERE {where} GROUP BY {batch}) "
            f"SELECT p.row_id, {cols} FROM {table} p JOIN s USING ({batch})")


@query("nrm_01_robust_mad", "WITH {profiles}, " + scaled("median({c})", "mad({c})", digits=9))
def _(t):
    return out_wide(nm.robust_mad(frame(t), ["plate"], F.col("negcon")), 9)


@query("nrm_01_robust_mad_global_scaled", """WITH {profiles}, s AS (SELECT median(f0) AS c0, mad(f0) / 1.4826 AS m0, median(f1) AS c1, mad(f1) / 1.4826 AS m1,
   median(f2) AS c2, mad(f2) / 1.4826 AS m2, median(f3) AS c3, mad(f3) / 1.4826 AS m3 FROM profiles)
  SELECT row_id, round((f0 - c0) / m0, 9) AS f0, round((f1 - c1) / m1, 9) AS f1, round((f2 - c2) / m2, 9) AS f2, round((f3 - c3) / m3, 9) AS f3 FROM profiles, s""")
def _(t):
    return out_wide(nm.robust_mad(frame(t), [], None, mad_divisor=1.4826), 9)


@query("nrm_02_standardize", "WITH {profiles}, " + scaled("avg({c})", "stddev_pop({c})"))
def _(t):
    return out_wide(nm.standardize(frame(t), ["plate"], F.col("negcon")))


@query("nrm_03_sample_normalize", """WITH {profiles}, n AS (SELECT *, sqrt(f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3) + 1e-10 AS l2,
   abs(f0) + abs(f1) + abs(f2) + abs(f3) + 1e-10 AS l1, greatest(abs(f0), abs(f1), abs(f2), abs(f3)) + 1e-10 AS lm FROM profiles)
  SELECT row_id, 'l2' AS norm, round(f0 / l2, 6) AS f0, round(f1 / l2, 6) AS f1 FROM n UNION ALL
  SELECT row_id, 'l1', round(f0 / l1, 6), round(f1 / l1, 6) FROM n UNION ALL SELECT row_id, 'max', round(f0 / lm, 6), round(f1 / lm, 6) FROM n""")
def _(t):
    out = None
    for kind in ("l2", "l1", "max"):
        part = nm.sample_normalize(frame(t), kind).wide().select(
            "row_id", F.lit(kind).alias("norm"), r6("f0").alias("f0"), r6("f1").alias("f1"))
        out = part if out is None else out.unionByName(part)
    return out


@query("nrm_04_well_position", """WITH {profiles}, m AS (SELECT well, avg(f0) AS a, avg(f1) AS b, avg(f2) AS c, avg(f3) AS d FROM profiles GROUP BY well)
  SELECT row_id, round((f0 - a) / 0.7310585786, 5) AS f0, round((f1 - b) / 0.7310585786, 4) AS f1, round((f2 - c) / 0.7310585786, 6) AS f2, round((f3 - d) / 0.7310585786, 6) AS f3 FROM profiles JOIN m USING (well)""")
def _(t):
    out = nm.well_position_correct(frame(t), "well").wide()
    # Differences of short decimals often end on an exact five; a common factor keeps both sides from rounding a tie.
    digits = {"f0": 5, "f1": 4, "f2": 6, "f3": 6}
    return out.select("row_id", *[r6(F.col(c) / 0.7310585786, digits[c]).alias(c) for c in FEATS])


def _int_sql():
    ranks = ", ".join(f"(row_number() OVER (ORDER BY {c}, row_id) - 0.375::DOUBLE) / (count(*) OVER () + 0.25::DOUBLE) AS p_{c}" for c in FEATS)
    cols = ", ".join(f"round({normal_quantile_sql('p_' + c)}, 6) AS {c}" for c in FEATS)
    return "WITH {profiles}, r AS (SELECT row_id, " + ranks + " FROM profiles) SELECT row_id, " + cols + " FROM r"


@query("nrm_05_inverse_normal", _int_sql())
def _(t):
    return out_wide(nm.inverse_normal_transform(frame(t)), 6)


@query("nrm_06_fit_scope_fallback", """WITH {profiles}, q AS (SELECT *, negcon AND plate % 7 <> 0 AS ctl FROM profiles),
  h AS (SELECT plate, bool_or(ctl) AS has FROM q GROUP BY plate),
  s AS (SELECT plate, avg(f0) AS m, stddev_pop(f0) AS d, count(*) AS n_fit FROM q JOIN h USING (plate) WHERE ctl OR NOT has GROUP BY plate)
  SELECT row_id, n_fit, round((f0 - m) / d, 5) AS f0 FROM q JOIN s USING (plate)""")
def _(t):
    df = t.profiles.withColumn("ctl", F.col("negcon") & (F.col("plate") % 7 != 0))
    pf = ProfileFrame.from_wide(df, FEATS)
    n_fit = nm.fit_rows(pf, ["plate"], F.col("ctl")).groupBy("plate").agg(F.count("*").alias("n_fit"))
    out = nm.standardize(pf, ["plate"], F.col("ctl")).wide()
    return out.join(n_fit, "plate").select("row_id", "n_fit", r6("f0", 5).alias("f0"))
