"""Average precision, activity, consistency, and position and plate effects."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import evaluate as ev
from phenospark.operators import normalize as nm
from phenospark.operators.aggregate import aggregate_profiles
from phenospark.operators.frame import ProfileFrame

FEATS = ["f0", "f1", "f2", "f3"]


def normalized(t) -> ProfileFrame:
    """Profiles standardized per plate on the controls."""
    return nm.standardize(ProfileFrame.from_wide(t.profiles, FEATS), ["plate"], F.col("negcon"))


Z_SQL = ("st AS (SELECT plate, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-18 AS d_{c}" for c in FEATS)
         + " FROM profiles WHERE negcon GROUP BY plate), zr AS (SELECT row_id, plate, compound, well, grp, negcon, "
         + ", ".join(f"({c} - m_{c}) / d_{c} AS {c}" for c in FEATS) + " FROM profiles JOIN st USING (plate)), "
         "z AS (SELECT row_id, plate, compound, well, grp, negcon, "
         + ", ".join(f"{c} / sqrt(f0 * f0 + f1 * f1 + f2 * f2 + f3 * f3) AS {c}" for c in FEATS) + " FROM zr)")
STEP_SQL = "CAST(round((" + " + ".join(f"q.{c} * r.{c}" for c in FEATS) + ") / 1e-6) AS BIGINT)"


def ap_sql(pos: str, neg: str, step: str = STEP_SQL, base: str = "z", key: str = "row_id", where: str = "true") -> str:
    """CTEs ending in ``ap(key, n_pos_pairs, n_total_pairs, average_precision)``: every pair ranked per query."""
    return f"""pairs AS (SELECT q.{key} AS k, {step} AS s, 1 AS pos FROM {base} q JOIN {base} r ON {pos} WHERE {where}
      UNION ALL SELECT q.{key}, {step}, 0 FROM {base} q JOIN {base} r ON {neg} WHERE {where}),
    rk AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY s DESC, pos DESC) AS rn,
      sum(pos) OVER (PARTITION BY k ORDER BY s DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM pairs),
    ap AS (SELECT k AS {key}, CAST(sum(pos) AS BIGINT) AS n_pos_pairs, count(*) AS n_total_pairs,
      avg(CASE WHEN pos = 1 THEN cp * 1.0::DOUBLE / rn END) AS average_precision FROM rk GROUP BY k HAVING sum(pos) > 0),
    hn AS (SELECT n AS n_total_pairs, list_sum(list_transform(range(1, n + 1), lambda x: 1.0::DOUBLE / x)) AS h FROM (SELECT DISTINCT n_total_pairs AS n FROM ap)),
    en AS (SELECT *, (h + (n_total_pairs - h) * (n_pos_pairs - 1) / (n_total_pairs - 1)) / n_total_pairs AS e FROM ap JOIN hn USING (n_total_pairs)),
    nap AS (SELECT {key}, n_pos_pairs, n_total_pairs, average_precision, CASE WHEN n_total_pairs > n_pos_pairs
      THEN (average_precision - e) / (1 - e) END AS normalized_average_precision FROM en)"""


ACTIVITY = ap_sql("q.compound = r.compound AND q.grp = r.grp AND q.row_id <> r.row_id AND NOT r.negcon",
                  "q.plate = r.plate AND q.grp = r.grp AND r.negcon AND q.compound <> r.compound", where="NOT q.negcon")
AP_COLS = "n_pos_pairs, n_total_pairs, round(average_precision, 6) AS average_precision, round(normalized_average_precision, 6) AS normalized_average_precision"


def ap_columns(df, *keys):
    return df.select(*keys, "n_pos_pairs", "n_total_pairs", r6("average_precision").alias("average_precision"),
                     r6("normalized_average_precision").alias("normalized_average_precision"))


# ---- a null table as an input, the same for all pair counts, so that SQL knows the p-values ------------

DRAWS, SHIFT = 400, 0.3141592653589793


def fixed_nulls(ap, top: float = 1.0):
    """Draws (i + SHIFT) / DRAWS * top for every pair of counts."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: (i + F.lit(SHIFT)) / DRAWS * top)
    return ap.select("n_pos_pairs", "n_total_pairs").distinct().withColumn("draws", draws)


def fixed_p_sql(observed: str, top: float = 1.0) -> str:
    return f"(1 + {DRAWS} - least({DRAWS}, greatest(0, ceil({observed} * {DRAWS} / {top} - {SHIFT})))) / {DRAWS + 1}.0::DOUBLE"


def adjusted_sql(table: str, name: str, family: str = "") -> str:
    """CTE with p adjusted as cp, within the family's columns."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""{name} AS (SELECT *, least(1.0, min(p * total / upto) OVER ({part} ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS cp
    FROM (SELECT *, count(*) OVER ({part}) AS total, count(*) OVER ({part} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {table}))"""


@query("evl_01_average_precision", f"WITH {{profiles}}, {Z_SQL}, {ACTIVITY} SELECT row_id, {AP_COLS} FROM nap")
def _(t):
    return ap_columns(ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp"), "row_id")


@query("evl_02_mean_average_precision")
def _(t):
    ap = ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp")
    return ev.mean_average_precision(ap, ["compound", "grp"], null_size=1000)


@query("evl_02_mean_precision_values", f"""WITH {{profiles}}, {Z_SQL}, {ACTIVITY}
  SELECT compound, grp, count(*) AS n_rows, round(avg(average_precision), 6) AS mean_average_precision,
    round(avg(normalized_average_precision), 6) AS mean_normalized_average_precision FROM nap JOIN profiles USING (row_id) GROUP BY compound, grp""")
def _(t):
    ap = ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp")
    out = ev.mean_average_precision(ap, ["compound", "grp"], null_size=50)
    return out.select("compound", "grp", "n_rows", r6("mean_average_precision").alias("mean_average_precision"),
                      r6("mean_normalized_average_precision").alias("mean_normalized_average_precision"))


@query("evl_03_row_p_values")
def _(t):
    ap = ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp")
    needed = ap.select("row_id", *ev.NULL_KEYS, "average_precision")
    return ev.row_p_values(needed, null_size=1000).select("row_id", "average_precision", "p_value")


@query("evl_03_p_values_of_given_nulls", f"WITH {{profiles}}, {Z_SQL}, {ACTIVITY} SELECT row_id, round({fixed_p_sql('average_precision')}, 8) AS p_value FROM nap")
def _(t):
    ap = ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp")
    needed = ap.select("row_id", *ev.NULL_KEYS, "average_precision")
    return ev.row_p_values(needed, nulls=fixed_nulls).select("row_id", r6("p_value", 8).alias("p_value"))


@query("evl_04_activity_of_given_nulls", f"""WITH {{profiles}}, {Z_SQL}, {ACTIVITY}, m AS (SELECT compound, grp, avg(average_precision) AS m FROM nap JOIN profiles USING (row_id) GROUP BY compound, grp),
  pv AS (SELECT *, {fixed_p_sql("m")} AS p FROM m), {adjusted_sql("pv", "adj")}
  SELECT compound, grp, round(m, 6) AS mean_average_precision, round(p, 8) AS p_value, round(cp, 8) AS corrected_p_value, cp < 0.2 AS below_corrected_p FROM adj""")
def _(t):
    from phenospark.session import materialize

    ap = materialize(ev.activity_precision(normalized(t), "compound", "negcon", "plate", "grp"), "ap")
    maps = ev.mean_average_precision(ap, ["compound", "grp"], threshold=0.2, nulls=fixed_nulls(ap))
    return maps.select("compound", "grp", r6("mean_average_precision").alias("mean_average_precision"), r6("p_value", 8).alias("p_value"),
                       r6("corrected_p_value", 8).alias("corrected_p_value"), "below_corrected_p")


@query("evl_04_phenotypic_activity")
def _(t):
    _, maps = ev.phenotypic_activity(normalized(t), "compound", "negcon", "plate", "grp", null_size=1000)
    return ev.activity_summary(maps, ["grp"], "compound")


@query("evl_04_activity_values", f"""WITH {{profiles}}, {Z_SQL}, {ACTIVITY},
   m AS (SELECT compound, grp, count(*) AS n_rows, avg(normalized_average_precision) AS nap FROM nap JOIN profiles USING (row_id) GROUP BY compound, grp)
  SELECT grp, round(avg(nap), 6) AS mean_nap, round(median(nap), 6) AS median_nap, round(avg(greatest(nap, 0)), 6) AS mean_nap_clipped,
   round(avg(n_rows), 6) AS mean_n_replicates, round(median(n_rows), 6) AS median_n_replicates, count(DISTINCT compound) AS n_unique_compounds FROM m GROUP BY grp""")
def _(t):
    _, maps = ev.phenotypic_activity(normalized(t), "compound", "negcon", "plate", "grp", null_size=50)
    s = ev.activity_summary(maps, ["grp"], "compound")
    cols = ["mean_nap", "median_nap", "mean_nap_clipped", "mean_n_replicates", "median_n_replicates"]
    return s.select("grp", *[r6(c).alias(c) for c in cols], "n_unique_compounds")


# ---- consistency on the embedding vectors: two labels per row ----------------------------------------

def labelled(t) -> ProfileFrame:
    df = t.vectors.withColumns({
        "targets": F.array(F.concat(F.lit("L"), F.col("compound").cast("string")),
                           F.concat(F.lit("M"), (F.col("row_id") % 7).cast("string"))),
        "grp": F.when(F.col("row_id") % 3 == 0, "a").otherwise("b"), "cmp": F.col("row_id")})
    return ProfileFrame(df, tuple(f"e{i}" for i in range(64)))


V_SQL = """v AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS grp, ['L' || label, 'M' || (vec_id % 7)] AS targets,
    CAST(embedding AS DOUBLE[]) AS e, label, vec_id % 8 AS batch FROM embeddings)"""
V_STEP = "CAST(round(list_cosine_similarity(q.e, r.e) / 1e-6) AS BIGINT)"


@query("evl_05_filter_targets", """WITH a AS (SELECT p_partkey AS compound, list_sort(list_distinct([p_name, p_type || p_size, 'unknown'])) AS targets FROM part WHERE p_partkey % 10 <> 0),
  x AS (SELECT compound, unnest(targets) AS t FROM a), ok AS (SELECT t FROM x WHERE t <> 'unknown' GROUP BY t HAVING count(DISTINCT compound) >= 8)
  SELECT compound, string_agg(t, '|' ORDER BY t) AS targets FROM x JOIN ok USING (t) GROUP BY compound""")
def _(t):
    df = t.part.select(F.col("p_partkey").alias("compound"), (F.col("p_partkey") % 10 == 0).alias("negcon"),
                       F.array("p_name", F.concat("p_type", F.col("p_size").cast("string")), F.lit("unknown")).alias("targets"))
    out = ev.filter_targets(df, "targets", "compound", "negcon", min_compounds=8, max_targets=50)
    return out.select("compound", F.array_join("targets", "|").alias("targets"))


CONSISTENCY = f"""{V_SQL}, l AS (SELECT row_id, grp, targets, e, unnest(targets) AS label, row_id || '/' || unnest(targets) AS rl FROM v),
  pairs AS (SELECT q.rl AS k, {V_STEP} AS s, 1 AS pos FROM l q JOIN l r ON q.grp = r.grp AND q.label = r.label AND q.row_id <> r.row_id
    UNION ALL SELECT q.rl, {V_STEP}, 0 FROM l q JOIN v r ON q.grp = r.grp AND NOT list_has_any(q.targets, r.targets)),
  rk AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY s DESC, pos DESC) AS rn,
    sum(pos) OVER (PARTITION BY k ORDER BY s DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM pairs),
  ap AS (SELECT k AS rl, CAST(sum(pos) AS BIGINT) AS n_pos_pairs, count(*) AS n_total_pairs,
    avg(CASE WHEN pos = 1 THEN cp * 1.0::DOUBLE / rn END) AS average_precision FROM rk GROUP BY k HAVING sum(pos) > 0)"""


@query("evl_06_consistency_precision", f"""WITH {CONSISTENCY}
  SELECT row_id, label, grp, n_pos_pairs, n_total_pairs, round(average_precision, 6) AS average_precision FROM ap JOIN l USING (rl)""")
def _(t):
    ap = ev.multilabel_precision(labelled(t), "targets", "grp")
    return ap.select("row_id", "label", "grp", "n_pos_pairs", "n_total_pairs", r6("average_precision").alias("average_precision"))


@query("evl_06_phenotypic_consistency")
def _(t):
    _, maps = ev.phenotypic_consistency(labelled(t), "targets", "cmp", "grp", null_size=500, max_targets=50)
    return maps


@query("evl_07_consistency_of_active")
def _(t):
    """Consistency among compounds whose replicates were found: the active ids gate the rows."""
    from phenospark.session import materialize

    pf = labelled(t)
    active = ev.average_precision(pf, ev.PairRule(("compound", "grp")), ev.PairRule(("batch", "grp"), ("compound",)))
    gate = active.groupBy("cmp").agg(F.avg("normalized_average_precision").alias("nap")).filter("nap > 0").select("cmp")
    gate = materialize(gate, "active")
    gated = pf.with_df(pf.df.join(gate, "cmp", "left_semi"))
    return ev.phenotypic_consistency(gated, "targets", "cmp", "grp", null_size=500, max_targets=50)[1]


GATED = f"""{V_SQL}, apairs AS (SELECT q.row_id AS k, {V_STEP} AS s, 1 AS pos FROM v q JOIN v r ON q.grp = r.grp AND q.label = r.label AND q.row_id <> r.row_id
    UNION ALL SELECT q.row_id, {V_STEP}, 0 FROM v q JOIN v r ON q.grp = r.grp AND q.batch = r.batch AND q.label <> r.label),
  ark AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY s DESC, pos DESC) AS rn,
    sum(pos) OVER (PARTITION BY k ORDER BY s DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM apairs),
  aap AS (SELECT k AS row_id, avg(CASE WHEN pos = 1 THEN cp * 1.0::DOUBLE / rn END) AS a FROM ark GROUP BY k HAVING sum(pos) > 0),
  am AS (SELECT label, grp, avg(a) AS m FROM aap JOIN v USING (row_id) GROUP BY label, grp),
  apv AS (SELECT *, {fixed_p_sql("m", 0.53)} AS p FROM am), {adjusted_sql("apv", "aadj")},
  act AS (SELECT DISTINCT label FROM aadj WHERE cp < 0.05), gv AS (SELECT * FROM v WHERE label IN (SELECT label FROM act) AND (SELECT count(*) FROM act) >= 2),
  ok AS (SELECT t FROM (SELECT label, unnest(targets) AS t FROM gv) GROUP BY t HAVING count(DISTINCT label) >= 2),
  fv AS (SELECT row_id, grp, any_value(e) AS e, list(t) AS targets FROM (SELECT row_id, grp, e, unnest(targets) AS t FROM gv) JOIN ok USING (t) GROUP BY row_id, grp),
  l AS (SELECT row_id, grp, targets, e, unnest(targets) AS tgt, row_id || '/' || unnest(targets) AS rl FROM fv WHERE len(targets) > 0),
  pairs AS (SELECT q.rl AS k, {V_STEP} AS s, 1 AS pos FROM l q JOIN l r ON q.grp = r.grp AND q.tgt = r.tgt AND q.row_id <> r.row_id
    UNION ALL SELECT q.rl, {V_STEP}, 0 FROM l q JOIN fv r ON q.grp = r.grp AND len(r.targets) > 0 AND NOT list_has_any(q.targets, r.targets)),
  rk AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY s DESC, pos DESC) AS rn,
    sum(pos) OVER (PARTITION BY k ORDER BY s DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM pairs),
  ap AS (SELECT k AS rl, avg(CASE WHEN pos = 1 THEN cp * 1.0::DOUBLE / rn END) AS a FROM rk GROUP BY k HAVING sum(pos) > 0),
  m AS (SELECT tgt, grp, count(*) AS n_rows, avg(a) AS m FROM ap JOIN l USING (rl) GROUP BY tgt, grp),
  pv AS (SELECT *, {fixed_p_sql("m", 0.5)} AS p FROM m), {adjusted_sql("pv", "adj")}"""


@query("evl_07_gated_by_significance", f"""WITH {GATED} SELECT tgt AS label, grp, n_rows, round(m, 6) AS mean_average_precision, round(p, 8) AS p_value, round(cp, 8) AS corrected_p_value, cp < 0.4 AS below_corrected_p,
    (SELECT count(*) FROM act) AS n_active FROM adj""")
def _(t):
    """Consistency among the labels whose activity is significant after correction, with a null table as an input."""
    from phenospark.session import materialize

    pf = labelled(t)
    pf = pf.with_df(materialize(pf.df, "labelled"))
    ap = materialize(ev.average_precision(pf, ev.PairRule(("compound", "grp")), ev.PairRule(("batch", "grp"), ("compound",))), "ap")
    activity = ev.mean_average_precision(ap, ["compound", "grp"], nulls=fixed_nulls(ap, 0.53))
    _, maps, _ = ev.consistency_of_active(pf, activity, "targets", "compound", "grp", min_compounds=2, p_threshold=0.4, nulls=lambda a: fixed_nulls(a, 0.5))
    n_active = activity.filter("below_corrected_p").select("compound").distinct().count()
    return maps.select("label", "grp", "n_rows", r6("mean_average_precision").alias("mean_average_precision"), r6("p_value", 8).alias("p_value"),
                       r6("corrected_p_value", 8).alias("corrected_p_value"), "below_corrected_p", F.lit(n_active).cast("bigint").alias("n_active"))


@query("evl_08_consistency_by_subset", f"""WITH {V_SQL}, s AS (SELECT v.*, subset FROM v, (VALUES ('all'), ('tier1'), ('tier2')) x(subset)
    WHERE subset = 'all' OR (subset = 'tier1' AND label < 5) OR (subset = 'tier2' AND label >= 5)),
  l AS (SELECT row_id, subset, targets, e, unnest(targets) AS label, subset || '/' || row_id || '/' || unnest(targets) AS rl FROM s),
  pairs AS (SELECT q.rl AS k, {V_STEP} AS st, 1 AS pos FROM l q JOIN l r ON q.subset = r.subset AND q.label = r.label AND q.row_id <> r.row_id
    UNION ALL SELECT q.rl, {V_STEP}, 0 FROM l q JOIN s r ON q.subset = r.subset AND NOT list_has_any(q.targets, r.targets)),
  rk AS (SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY st DESC, pos DESC) AS rn,
    sum(pos) OVER (PARTITION BY k ORDER BY st DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM pairs),
  ap AS (SELECT k AS rl, avg(CASE WHEN pos = 1 THEN cp * 1.0::DOUBLE / rn END) AS a FROM rk GROUP BY k HAVING sum(pos) > 0)
  SELECT subset, label, count(*) AS n, round(avg(a), 6) AS mean_ap FROM ap JOIN l USING (rl) GROUP BY subset, label""")
def _(t):
    pf = labelled(t)
    base = pf.df.select("cmp", "compound")
    subsets = (base.select("cmp", F.lit("all").alias("subset"))
               .unionByName(base.select("cmp", F.when(F.col("compound") < 5, "tier1").otherwise("tier2").alias("subset"))))
    ap = ev.consistency_by_subset(pf, subsets, "targets", "cmp")
    return ap.groupBy("subset", "label").agg(F.count("*").alias("n"), r6(F.avg("average_precision")).alias("mean_ap"))


# ---- position and plate effects ----------------------------------------------------------------------

BUCKET_SQL = "(q.compound * 7 + q.plate) % 5 = (r.compound * 7 + r.plate) % 5"


@query("evl_09_position_effect", f"""WITH {{profiles}}, {Z_SQL}, w AS (SELECT * FROM z WHERE NOT negcon AND (grp, well) IN
    (SELECT (grp, well) FROM z WHERE NOT negcon GROUP BY grp, well HAVING count(DISTINCT plate) >= 2)), """ + ap_sql(
    "q.grp = r.grp AND q.well = r.well AND q.plate <> r.plate AND q.compound <> r.compound",
    "q.grp = r.grp AND q.plate = r.plate AND q.well <> r.well AND q.compound <> r.compound", base="w") + f"""
  SELECT well, grp, count(*) AS n, round(avg(average_precision), 6) AS mean_ap FROM nap JOIN profiles USING (row_id) GROUP BY well, grp""")
def _(t):
    z = normalized(t)
    rows = z.with_df(z.df.filter("NOT negcon"))
    ap = ev.position_effect(rows, "well", "plate", "compound", "grp")
    return ap.groupBy("well", "grp").agg(F.count("*").alias("n"), r6(F.avg("average_precision")).alias("mean_ap"))


@query("evl_09_position_effect_bucketed", f"""WITH {{profiles}}, {Z_SQL}, w AS (SELECT * FROM z WHERE NOT negcon AND (grp, well) IN
    (SELECT (grp, well) FROM z WHERE NOT negcon GROUP BY grp, well HAVING count(DISTINCT plate) >= 2)), """ + ap_sql(
    "q.grp = r.grp AND q.well = r.well AND q.plate <> r.plate AND q.compound <> r.compound",
    f"q.grp = r.grp AND q.plate = r.plate AND {BUCKET_SQL} AND q.well <> r.well AND q.compound <> r.compound", base="w") + f"""
  SELECT well, grp, count(*) AS n, round(avg(average_precision), 6) AS mean_ap FROM nap JOIN profiles USING (row_id) GROUP BY well, grp""")
def _(t):
    """Negatives from the query's own bucket, as a caller may ask for."""
    z = normalized(t)
    rows = z.with_df(z.df.filter("NOT negcon"))
    ap = ev.position_effect(rows, "well", "plate", "compound", "grp", bucket=(F.col("compound") * 7 + F.col("plate")) % 5)
    return ap.groupBy("well", "grp").agg(F.count("*").alias("n"), r6(F.avg("average_precision")).alias("mean_ap"))


@query("evl_09_position_effect_sampled")
def _(t):
    z = normalized(t)
    ap = ev.position_effect(z.with_df(z.df.filter("NOT negcon")), "well", "plate", "compound", "grp", rows_per_bucket=15, seed=0)
    return ev.mean_average_precision(ap, ["grp", "well"], null_size=200)


@query("evl_10_plate_effect")
def _(t):
    """All pairs; no SQL, as it would write billions of them: tests compare with brute force."""
    z = normalized(t)
    ap = ev.plate_effect(z.with_df(z.df.filter("NOT negcon")), "well", "plate", "compound", "grp")
    return ap.groupBy("plate", "grp").agg(F.count("*").alias("n"), r6(F.avg("average_precision")).alias("mean_ap"))


@query("evl_10_plate_effect_bucketed", f"WITH {{profiles}}, {Z_SQL}, w AS (SELECT * FROM z WHERE NOT negcon), " + ap_sql(
    f"q.grp = r.grp AND q.plate = r.plate AND {BUCKET_SQL} AND q.compound <> r.compound",
    "q.grp = r.grp AND (q.compound * 3 + q.plate) % 97 = (r.compound * 3 + r.plate) % 97 AND q.plate <> r.plate AND q.well <> r.well AND q.compound <> r.compound",
    base="w") + """ SELECT plate, grp, count(*) AS n, round(avg(average_precision), 6) AS mean_ap FROM nap JOIN profiles USING (row_id) GROUP BY plate, grp""")
def _(t):
    """Partners from the query's own buckets, as a caller may ask for."""
    z = normalized(t)
    ap = ev.plate_effect(z.with_df(z.df.filter("NOT negcon")), "well", "plate", "compound", "grp",
                         pos_bucket=(F.col("compound") * 7 + F.col("plate")) % 5, neg_bucket=(F.col("compound") * 3 + F.col("plate")) % 97)
    return ap.groupBy("plate", "grp").agg(F.count("*").alias("n"), r6(F.avg("average_precision")).alias("mean_ap"))


@query("evl_10_plate_effect_sampled")
def _(t):
    z = normalized(t)
    ap = ev.plate_effect(z.with_df(z.df.filter("NOT negcon")), "well", "plate", "compound", "grp", rows_per_bucket=(15, 25), seed=0)
    return ev.mean_average_precision(ap, ["grp", "plate"], null_size=200)


@query("evl_11_control_plate_effect", f"WITH {{profiles}}, {Z_SQL}, w AS (SELECT * FROM z WHERE negcon), " + ap_sql(
    "q.grp = r.grp AND q.plate = r.plate AND q.row_id <> r.row_id", "q.grp = r.grp AND q.plate <> r.plate AND q.well <> r.well", base="w")
    + f" SELECT row_id, {AP_COLS} FROM nap")
def _(t):
    """Controls only, without random buckets: same plate against other plates and positions."""
    z = normalized(t)
    rows = z.with_df(z.df.filter("negcon"))
    ap = ev.average_precision(rows, ev.PairRule(("grp", "plate")), ev.PairRule(("grp",), ("plate", "well")))
    return ap_columns(ap, "row_id")


@query("evl_12_evaluate_all")
def _(t):
    """All measures of one run in one row, with the variance share of the first two axes."""
    from phenospark.operators.quality import leading_variance

    pf = normalized(t)
    ap, maps = ev.phenotypic_activity(pf, "compound", "negcon", "plate", "grp", null_size=500)
    consistency = ev.phenotypic_consistency(labelled(t), "targets", "cmp", "grp", null_size=500, max_targets=50)[1]
    pc1, pc2 = leading_variance(pf, 2)
    pa = ev.activity_summary(maps, [], "compound")
    pc = consistency.agg((F.avg(F.col("below_corrected_p").cast("double")) * 100).alias("pct_consistent"),
                         F.avg("mean_normalized_average_precision").alias("consistency_nap"))
    return pa.join(F.broadcast(pc)).withColumns({"pc1_variance": F.lit(pc1), "pc2_variance": F.lit(pc2)})


@query("evl_13_group_as_key", f"""WITH {{profiles}}, {Z_SQL}, {ap_sql(
    'q.plate = r.plate AND q.row_id <> r.row_id', 'q.well = r.well AND q.plate <> r.plate')}
  SELECT count(*) AS n, CAST(sum(n_pos_pairs) AS BIGINT) AS pos, CAST(sum(n_total_pairs) AS BIGINT) AS total, round(avg(average_precision), 6) AS mean_ap FROM nap""")
def _(t):
    ap = ev.average_precision(normalized(t), ev.PairRule(("plate",)), ev.PairRule(("well",), ("plate",)), block=256)
    return ap.agg(F.count("*").alias("n"), F.sum("n_pos_pairs").alias("pos"), F.sum("n_total_pairs").alias("total"),
                  r6(F.avg("average_precision")).alias("mean_ap"))


def theta_sql(pos):
    return f"SELECT k AS row_id, count(*) AS n FROM (SELECT q.row_id AS k FROM profiles q JOIN profiles r ON {pos}) GROUP BY k"


@query("jon_23_theta_pairs", "WITH {profiles} " + theta_sql("q.grp = r.grp AND q.compound = r.compound AND q.plate <> r.plate"))
def _(t):
    """Partners per row: equal on some columns, different on others, counted without writing the pairs."""
    pf = normalized(t)
    ap = ev.average_precision(pf, ev.PairRule(("grp", "compound"), ("plate",)), ev.PairRule(("plate",), ("compound",), F.col("negcon")))
    return ap.select("row_id", F.col("n_pos_pairs").alias("n"))
