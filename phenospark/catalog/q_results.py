"""Analytics over result rows of many configurations."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.catalog.q_evaluate import FEATS, adjusted_sql, ap_sql, fixed_nulls, fixed_p_sql
from phenospark.operators import relational as rel
from phenospark.operators import normalize as nm
from phenospark.operators import results as rs
from phenospark.operators import saturation as sat
from phenospark.operators.frame import ProfileFrame

KEEP = ["family", "codec", "config", "pa"]


@query("exp_01_gather_results", """WITH {runs} SELECT family AS model, config, round(avg(pa), 6) AS pa, round(max(pa) FILTER (WHERE codec = 'codec0'), 6) AS "PA_codec0_mean",
  round(max(pa) FILTER (WHERE codec = 'codec2'), 6) AS "PA_codec2_mean" FROM runs GROUP BY family, config""")
def _(t):
    from phenospark.catalog.q_sources import METRIC_SCHEMA, run_files
    from phenospark.operators.reshape import flatten_groups
    from phenospark.sources.io import load_metrics

    df = load_metrics(t.spark, run_files(t), METRIC_SCHEMA, name="*.json")
    tidy = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    df = df.withColumns({"model": tidy("model"), "config": tidy("config")})
    return flatten_groups(df, ["model", "config", "pa"], "groups", "PA", ["codec0", "codec2"], ["mean"])


@query("exp_02_selection_scores", """WITH {runs} SELECT family, codec, config, round(pa * pc / 100, 6) AS balanced, round((pa / max(pa) OVER ()) * (pc / max(pc) OVER ()), 6) AS nap_balanced FROM runs""")
def _(t):
    a = rs.with_selection_score(t.runs, "pa", "pc", "balanced", "balanced")
    b = rs.with_selection_score(a, "pa", "pc", "nap_balanced", "nap_balanced")
    return b.select("family", "codec", "config", r6("balanced").alias("balanced"), r6("nap_balanced").alias("nap_balanced"))


@query("exp_03_best_per_codec", "WITH {runs} SELECT family, codec, max_by(config, (pa, config)) AS config, max(pa) AS pa FROM runs GROUP BY family, codec")
def _(t):
    return rs.best_configs(t.runs, "family", "codec", "config", "pa", "per_codec").select(*KEEP)


@query("exp_03_best_any_codec", """WITH {runs}, p AS (SELECT family, max_by(config, (pa, config)) AS config FROM runs GROUP BY family) SELECT family, codec, config, pa FROM runs JOIN p USING (family, config)""")
def _(t):
    return rs.best_configs(t.runs, "family", "codec", "config", "pa", "best_any_codec").select(*KEEP)


@query("exp_03_best_avg_codec", """WITH {runs}, m AS (SELECT family, config, avg(pa) AS s FROM runs GROUP BY ALL), p AS (SELECT family, max_by(config, (s, config)) AS config FROM m GROUP BY family)
  SELECT family, codec, config, pa FROM runs JOIN p USING (family, config)""")
def _(t):
    return rs.best_configs(t.runs, "family", "codec", "config", "pa", "best_avg_codec").select(*KEEP)


BASE_SQL = "b AS (SELECT family, min_by(codec, (CASE codec WHEN 'codec2' THEN 0 WHEN 'codec0' THEN 1 ELSE 2 END, codec)) AS baseline FROM runs GROUP BY family)"


@query("exp_04_baseline_codec", "WITH {runs}, " + BASE_SQL + " SELECT family, baseline FROM b")
def _(t):
    return rs.baseline_codec(t.runs, "family", "codec", ["codec2", "codec0"])


DELTA_SQL = BASE_SQL + """, d AS (SELECT r.family, r.codec, r.config, r.pa, x.pa AS base, r.pa - x.pa AS delta FROM runs r JOIN b USING (family) JOIN runs x ON x.family = r.family AND x.config = r.config AND x.codec = b.baseline)"""


def deltas(t):
    base = rs.baseline_codec(t.runs, "family", "codec", ["codec2", "codec0"])
    return rs.baseline_deltas(t.runs, ["family", "config"], "codec", "pa", base, "family")


@query("exp_05_baseline_deltas", "WITH {runs}, " + DELTA_SQL + " SELECT family, codec, config, round(delta, 6) AS delta FROM d")
def _(t):
    return deltas(t).select("family", "codec", "config", r6("delta").alias("delta"))


PCT_SQL = DELTA_SQL + ", p AS (SELECT *, CASE WHEN greatest(base, 0) > 1e-12 THEN (greatest(pa, 0) - greatest(base, 0)) / greatest(base, 0) * 100 END AS pct FROM d)"


@query("exp_06_percent_deltas", "WITH {runs}, " + PCT_SQL + " SELECT family, codec, round(avg(pct), 4) AS mean, round(stddev_samp(pct), 4) AS std, count(pct) AS n FROM p GROUP BY family, codec")
def _(t):
    pct = deltas(t).withColumn("pct", rs.percent_delta(F.col("pa"), F.col("base_score")))
    return rs.codec_delta_summary(pct, ["family", "codec"]).withColumns({"mean": r6("mean", 4), "std": r6("std", 4)})


@query("exp_07_balanced_root", "WITH {runs} SELECT family, codec, config, round(sqrt(greatest(pa, 0) * greatest(pc, 0)), 6) AS score FROM runs")
def _(t):
    return t.runs.select("family", "codec", "config", r6(rs.balanced_root(F.col("pa"), F.col("pc"))).alias("score"))


@query("exp_08_task_ranks", """WITH {runs}, s AS (SELECT family, round(avg(pa) FILTER (WHERE codec = 'codec0'), 6) AS t0, round(avg(pc) FILTER (WHERE codec = 'codec0'), 6) AS t1 FROM runs GROUP BY family),
   l AS (SELECT family, 't0' AS task, t0 AS score FROM s UNION ALL SELECT family, 't1', t1 FROM s)
  SELECT family, task, score, CAST(rank() OVER (PARTITION BY task ORDER BY score DESC) AS DOUBLE) AS rank FROM l""")
def _(t):
    at = F.col("codec") == "codec0"
    wide = t.runs.groupBy("family").agg(r6(F.avg(F.when(at, F.col("pa")))).alias("t0"), r6(F.avg(F.when(at, F.col("pc")))).alias("t1"))
    return rs.rank_within(wide.unpivot(["family"], ["t0", "t1"], "task", "score"), ["task"], "score")


@query("exp_09_top_configs", """WITH {runs} SELECT 'data/' || family || '/' || codec || '/' || config AS path FROM (SELECT *, row_number() OVER (PARTITION BY family, codec ORDER BY pa DESC NULLS LAST, config) AS rn FROM runs) WHERE rn <= 3""")
def _(t):
    return rs.top_configs(t.runs, "family", "codec", "config", "pa", 3).select(F.concat_ws("/", F.lit("data"), "family", "codec", "config").alias("path"))


SATURATION_SQL = f"""WITH {{profiles}}, t AS (SELECT DISTINCT compound FROM profiles WHERE NOT negcon),
  o AS (SELECT compound, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(compound || '/' || seed), compound) AS rn FROM t, (VALUES (0), (1)) v(seed)),
  mem AS (SELECT compound, fraction, seed FROM o, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) f(fraction) WHERE rn <= greatest(1, floor(fraction * (SELECT count(*) FROM t)))),
  runs AS (SELECT DISTINCT fraction, seed FROM mem),
  rows_ AS (SELECT p.*, fraction, seed FROM profiles p JOIN mem USING (compound) WHERE NOT negcon UNION ALL SELECT p.*, fraction, seed FROM profiles p, runs WHERE negcon),
  st AS (SELECT plate, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-18 AS d_{c}" for c in FEATS)} FROM profiles WHERE negcon GROUP BY plate),
  zr AS (SELECT row_id || '/' || fraction || '/' || seed || '/' || config AS row_id, plate, compound, grp, negcon, fraction, seed, config,
    {", ".join(f"CASE WHEN config = 'a' THEN ({c} - m_{c}) / d_{c} ELSE {c} END AS {c}" for c in FEATS)} FROM rows_ JOIN st USING (plate), (VALUES ('a'), ('b')) c(config)),
  z AS (SELECT * EXCLUDE ({", ".join(FEATS)}), {", ".join(f"{c} / sqrt(f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3) AS {c}" for c in FEATS)} FROM zr),
  """ + ap_sql("q.config = r.config AND q.fraction = r.fraction AND q.seed = r.seed AND q.compound = r.compound AND q.grp = r.grp AND q.row_id <> r.row_id AND NOT r.negcon",
               "q.config = r.config AND q.fraction = r.fraction AND q.seed = r.seed AND q.plate = r.plate AND q.grp = r.grp AND r.negcon AND q.compound <> r.compound", where="NOT q.negcon") + f""",
  g AS (SELECT config, fraction, seed, compound, grp, avg(average_precision) AS m FROM nap JOIN zr USING (row_id) GROUP BY ALL),
  pv AS (SELECT *, {fixed_p_sql("m")} AS p FROM g), {adjusted_sql("pv", "adj", "config, fraction, seed")},
  sc AS (SELECT fraction, seed, config, count(DISTINCT compound) AS n_treatments, avg(m) AS mean_ap, avg(CASE WHEN cp < 0.05 THEN 100.0::DOUBLE ELSE 0 END) AS pct_active FROM adj GROUP BY ALL)
  SELECT fraction, CAST(seed AS INT) AS seed, config, n_treatments, round(mean_ap, 6) AS mean_ap, round(pct_active, 6) AS pct_active,
    row_number() OVER (PARTITION BY fraction, seed ORDER BY mean_ap DESC, config DESC) = 1 AS is_best FROM sc"""


@query("exp_10_saturation", SATURATION_SQL)
def _(t):
    """Nested subsamples of treatments, normalized and scored in one plan under two configurations; the best one per run."""
    pf = ProfileFrame.from_wide(t.profiles, FEATS)
    configs = {"a": lambda x, batch, control: nm.standardize(x, batch, control), "b": lambda x, batch, control: x}
    scores, best = sat.saturation(pf, "compound", "negcon", "plate", (0.05, 0.1, 0.2), (0, 1), configs, "grp", nulls=fixed_nulls)
    flag = best.select("fraction", "seed", F.col("config").alias("_best"))
    out = scores.join(flag, ["fraction", "seed"])
    return out.select("fraction", "seed", "config", "n_treatments", r6("mean_ap").alias("mean_ap"), r6("pct_active").alias("pct_active"), (F.col("config") == F.col("_best")).alias("is_best"))


@query("exp_11_config_grid")
def _(t):
    """Expanded grid without configurations that repeat another one, joined to the runs they belong to."""
    from phenospark.plans import steps as st

    grid = st.expand_grid({"norm_method": ["robustmad", "standardize"], "batch_method": ["none", "tvn_efaar", "spherize"],
                           "tvn_efaar_epsilon": [0.5, 1.0], "spherize_epsilon": [0.1, 1.0], "use_pca": [False, True]})
    rows = [(i, st.output_name(st.configure(st.PRESETS["full"], c)), st.redundant(c)) for i, c in enumerate(grid)]
    plan = t.spark.createDataFrame(rows, "cfg int, name string, skipped string").filter("skipped IS NULL").drop("skipped")
    runs = t.runs.withColumn("cfg", F.regexp_extract("config", "([0-9]+)$", 1).cast("int"))
    return runs.join(F.broadcast(plan), "cfg").groupBy("name").agg(F.count("*").alias("n_runs"), F.max("pa").alias("best"))


@query("exp_12_merge_metrics", """SELECT coalesce(a.codec, b.codec) AS codec, size, quality FROM (SELECT c_mktsegment AS codec, round(avg(c_nationkey), 6) AS size FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
  FULL JOIN (SELECT c_mktsegment AS codec, round(max(c_acctbal), 2) AS quality FROM customer WHERE c_nationkey < 3 GROUP BY 1) b ON a.codec = b.codec""")
def _(t):
    size = t.customer.filter("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("codec")).agg(r6(F.avg("c_nationkey")).alias("size"))
    quality = t.customer.filter("c_nationkey < 3").groupBy(F.col("c_mktsegment").alias("codec")).agg(r6(F.max("c_acctbal"), 2).alias("quality"))
    return size.join(quality, "codec", "outer")


@query("exp_13_macro_means", "WITH {runs}, m AS (SELECT codec, family, avg(pa) AS pa FROM runs GROUP BY ALL) SELECT codec, round(avg(pa), 6) AS pa, count(*) AS n_groups FROM m GROUP BY codec")
def _(t):
    return rs.macro_mean(t.runs, ["codec", "family"], ["codec"], "pa").withColumn("pa", r6("pa"))


STABLE = """rk AS (SELECT {x}a.codec AS codec_a, b.codec AS codec_b, rank() OVER (PARTITION BY {x}a.codec, b.codec ORDER BY a.s) AS ra, rank() OVER (PARTITION BY {x}a.codec, b.codec ORDER BY b.s) AS rb
   FROM best a JOIN best b ON a.family = b.family AND a.codec < b.codec {j})"""


@query("sta_14_rank_stability", "WITH {runs}, best AS (SELECT family, codec, max(pa) AS s FROM runs GROUP BY ALL), " + STABLE.format(x="", j="") + """
  SELECT codec_a, codec_b, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM rk GROUP BY ALL HAVING count(*) >= 3""")
def _(t):
    best = rs.best_row(t.runs.select(*KEEP), ["family", "codec"], "pa", ["config"])
    return rs.rank_stability(best, "family", "codec", "pa").withColumn("rho", r6("rho"))


@query("sta_15_config_stability", "WITH {runs}, best AS (SELECT config, family, codec, pa AS s FROM runs), " + STABLE.format(x="a.config, ", j="AND a.config = b.config") + """,
   c AS (SELECT config, codec_a, codec_b, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM rk GROUP BY ALL HAVING count(*) >= 3)
  SELECT codec_a, codec_b, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS std, round(min(rho), 6) AS min, round(max(rho), 6) AS max, count(rho) AS n FROM c GROUP BY ALL""")
def _(t):
    per = rs.rank_stability(t.runs, "family", "codec", "pa", extra=["config"])
    return per.groupBy("codec_a", "codec_b").agg(r6(F.avg("rho")).alias("mean"), r6(F.stddev_samp("rho")).alias("std"),
                                                 r6(F.min("rho")).alias("min"), r6(F.max("rho")).alias("max"), F.count("rho").alias("n"))
