"""Scalar functions over whole columns."""

import re

from pyspark.sql import functions as F

from phenospark.catalog.base import normal_quantile_sql, query, r6
from phenospark.functions import names
from phenospark.functions.scalar import dice_from_iou, object_key, safe_ratio, with_normal_quantile


@query("fun_01_split_part", "SELECT c_custkey, split_part(c_name, '#', 2) AS tail, split_part(split_part(c_name, '#', 1), 'st', 1) AS head FROM customer")
def _(t):
    parts = F.split("c_name", "#")
    return t.customer.select("c_custkey", parts[1].alias("tail"), F.split(parts[0], "st")[0].alias("head"))


@query("fun_02_concat_ws", "SELECT concat_ws('__', s_name, s_nationkey, s_suppkey) AS k FROM supplier")
def _(t):
    return t.supplier.select(F.concat_ws("__", "s_name", "s_nationkey", "s_suppkey").alias("k"))


@query("fun_03_format_uri", "SELECT 's3://bucket/' || o_orderstatus || '/load_data/' || o_custkey || '/' || o_orderkey || '.csv' AS uri FROM orders")
def _(t):
    return t.orders.select(F.format_string("s3://bucket/%s/load_data/%d/%d.csv", "o_orderstatus", "o_custkey", "o_orderkey").alias("uri"))


@query("fun_04_remove_prefix_suffix", "SELECT c_custkey, regexp_replace(regexp_replace(c_name, '^Customer#', ''), '0$', '') AS short FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_replace(F.regexp_replace("c_name", "^Customer#", ""), "0$", "").alias("short"))


@query("fun_05_regex_extract", r"SELECT url, regexp_extract(url, '^([a-z]+)', 1) AS scheme, regexp_extract(url, '/([^/]+)$', 1) AS leaf FROM pages")
def _(t):
    return t.pages.select("url", F.regexp_extract("url", "^([a-z]+)", 1).alias("scheme"), F.regexp_extract("url", "/([^/]+)$", 1).alias("leaf"))


FAMILY_SQL = "CASE " + " ".join(f"WHEN starts_with(m, '{f}') THEN '{f}'" for f in sorted(names.MODEL_FAMILIES, key=len, reverse=True)) + " END"


@query("fun_06_model_names", """WITH n AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'subcell_nonstd' WHEN 1 THEN 'dinov2' WHEN 2 THEN 'morphem'
    WHEN 3 THEN 'baseline' ELSE 'openphenom_stdscale' END AS m, lower(p_type) AS codec FROM part)
  SELECT p_partkey, """ + FAMILY_SQL + """ AS family, CASE WHEN m = 'baseline' THEN codec || '_raw' ELSE m || '_small_' || codec || '_raw' END AS short FROM n""")
def _(t):
    model = (F.when(F.col("p_size") % 5 == 0, "subcell_nonstd").when(F.col("p_size") % 5 == 1, "dinov2")
             .when(F.col("p_size") % 5 == 2, "morphem").when(F.col("p_size") % 5 == 3, "baseline").otherwise("openphenom_stdscale"))
    folder = t.part.select("p_partkey", F.concat(model, F.lit("_plates_v2_"), F.lower("p_type"), F.lit("_raw_features")).alias("folder"))
    short = names.short_model_name(F.col("folder"), {"plates_v2": "_small", "plates": ""}, unprefixed=["baseline"])
    return folder.select("p_partkey", names.family(F.col("folder")).alias("family"), short.alias("short"))


@query("fun_07_config_names", """WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, c_nationkey AS v FROM customer)
  SELECT c_custkey, CASE WHEN k % 2 = 0 THEN 'robustmad' ELSE 'standardize' END AS norm_method, CASE WHEN k > 2 THEN v + 1 END AS outlier_cutoff,
   k = 3 AS use_int, round((80 + v % 20) / 100.0::DOUBLE, 2) AS prune_thresh, k = 1 AS use_pca, CASE WHEN k = 1 THEN v + 2 END AS pca_components,
   CASE k WHEN 0 THEN 'tvn_efaar' WHEN 2 THEN 'spherize' WHEN 3 THEN 'tvn_original' WHEN 4 THEN 'cascade_tvn' WHEN 5 THEN 'spherize_global' ELSE 'none' END AS batch_method,
   CASE k WHEN 2 THEN 'all' WHEN 5 THEN 'ctrl' END AS spherize_fit, CASE k WHEN 2 THEN 1e-6 WHEN 5 THEN 0.5 END AS spherize_epsilon,
   CASE k WHEN 0 THEN 0.5 END AS tvn_epsilon, CASE k WHEN 3 THEN v + 3 END AS tvn_original_k,
   CASE k WHEN 0 THEN CASE WHEN v % 2 = 0 THEN 128 ELSE v + 4 END END AS tvn_efaar_n_components,
   CASE k WHEN 4 THEN 64 END AS tvn_cascade_k1, CASE k WHEN 4 THEN v + 5 END AS tvn_cascade_k2 FROM c""")
def _(t):
    k, v = F.col("c_custkey") % 6, F.col("c_nationkey")
    text = lambda c: c.cast("string")
    batch = (F.when(k == 0, F.concat(F.lit("tvn_efaar_e0.5"), F.when(v % 2 == 0, "").otherwise(F.concat(F.lit("_c"), text(v + 4)))))
             .when(k == 2, "ZCA-cor_all_e6").when(k == 3, F.concat(F.lit("tvn_original_k"), text(v + 3)))
             .when(k == 4, F.concat(F.lit("cascade_tvn_k64_k"), text(v + 5))).when(k == 5, "ZCA-cor_global_ctrl_e0.5"))
    name = F.concat_ws("__", F.when(k % 2 == 0, "robustmad_ctrl").otherwise("std_ctrl"), F.when(k > 2, F.concat(F.lit("outlier"), text(v + 1))),
                       F.when(k == 3, "INT"), F.concat(F.lit("prune0."), text(80 + v % 20)),
                       F.when(k == 1, F.concat(F.lit("pca"), text(v + 2))), batch)
    return t.customer.select("c_custkey", names.parse_config(name).alias("s")).select("c_custkey", "s.*")


@query("fun_08_config_generator")
def _(t):
    """Generated names parsed back: the settings of each grid row survive the round trip."""
    from phenospark.plans import steps as st

    # The grid grows with the data: one outlier cutoff per nation.
    cutoffs = [r[0] for r in t.nation.select("n_nationkey").orderBy("n_nationkey").collect()]
    grid = st.expand_grid({"norm_method": ["robustmad", "standardize"], "batch_method": ["none", "tvn_efaar", "spherize"], "outlier_cutoff": cutoffs})
    rows = [(c["norm_method"], c["batch_method"], c["outlier_cutoff"], st.output_name(st.configure(st.PRESETS["full"], c))) for c in grid]
    df = t.spark.createDataFrame(rows, "norm string, batch string, cutoff int, name string")
    s = names.parse_config(F.col("name"))
    return df.select("name", (s["norm_method"] == F.col("norm")).alias("norm_ok"), (s["batch_method"] == F.col("batch")).alias("batch_ok"),
                     (s["outlier_cutoff"] == F.col("cutoff")).alias("cutoff_ok"))


FEATURE_WORDS = ["Contrast_3", "0_IntegratedIntensity", "FracAtD_1", "Zernike_4_0", "Granularity_2", "AreaFilled", "Unknown", "1_VarianceX",
                 "RadialDistribution_2", "Location_Center_X"]
GROUP_OF = ["Texture", "Intensity", "RadialDistribution", "Zernike", "Granularity", "SizeShape", "Other", "Texture", "RadialDistribution", "Intensity"]


def word(col, words):
    return F.get(F.array(*[F.lit(w) for w in words]), (F.col(col) % len(words)).cast("int"))


def word_sql(col, words):
    return "CASE " + f"{col} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


@query("fun_09_feature_groups", f"SELECT p_partkey, {word_sql('p_partkey', GROUP_OF)} AS grp FROM part")
def _(t):
    return t.part.select("p_partkey", names.feature_group(word("p_partkey", FEATURE_WORDS)).alias("grp"))


SUB_WORDS = ["zernikeZernike_4_0", "radial_zernikesRadialDistribution_ZernikePhase_7_3", "radial_distributionRadialDistribution_FracAtD_4of4",
             "sizeshapeArea", "sizeshapeCentralMoment_0_0", "sizeshapeBoundingBoxArea", "plain"]
SUB_OF = ["4_0", "zernikesRadialDistribution_ZernikePhase", "distributionRadialDistribution_FracAtD", "Area", "CentralMoment", "BoundingBoxArea", "plain"]


@query("fun_10_feature_subcategory", f"SELECT p_partkey, {word_sql('p_partkey', SUB_OF)} AS sub FROM part")
def _(t):
    return t.part.select("p_partkey", names.feature_subcategory(word("p_partkey", SUB_WORDS)).alias("sub"))


MAP_WORDS = ["cell_0/max/sizeshapeArea", "nuclei_1/max/textureContrast_3_00", "cytoplasm_3/max/intensityIntensity_MeanIntensity",
             "cell_4/max/radial_distributionRadialDistribution_FracAtD_1of4", "cell_2/max/intensityLocation_Center_X", "odd", "cell_1/max/unknownThing"]
MAP_OF = ["Cells_AreaShape_Area", "Nuclei_Texture_Contrast_AGP_3_00", "Cytoplasm_Intensity_MeanIntensity_RNA",
          "Cells_RadialDistribution_FracAtD_ER_1of4", "Cells_Location_Center_X_Mito"]


@query("fun_11_name_mapping", "SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(MAP_OF)) + " END AS mapped FROM part")
def _(t):
    return t.part.select("p_partkey", names.canonical_feature(word("p_partkey", MAP_WORDS)).alias("mapped"))


@query("fun_11_mapping_coverage", """
  WITH b AS (SELECT DISTINCT 'cell_' || (p_size % 7) || '/max/textureContrast_' || p_partkey AS b FROM part),
   k AS (SELECT 'Cells_Texture_Contrast_' || CASE p_size % 7 WHEN 0 THEN 'DNA' WHEN 1 THEN 'AGP' WHEN 2 THEN 'Mito' WHEN 3 THEN 'RNA' WHEN 4 THEN 'ER' END || '_' || p_partkey AS k FROM part WHERE p_partkey % 3 <> 0)
  SELECT (SELECT count(DISTINCT k) FROM k) AS total_a, (SELECT count(*) FROM b) AS total_b, (SELECT count(DISTINCT k) FROM k) AS mapped_a,
   (SELECT count(DISTINCT k) FROM k) AS mapped_b""")
def _(t):
    b = t.part.select(F.format_string("cell_%d/max/textureContrast_%d", F.col("p_size") % 7, "p_partkey").alias("feature"))
    a = t.part.filter("p_partkey % 3 <> 0 AND p_size % 7 < 5").select(names.canonical_feature(
        F.format_string("cell_%d/max/textureContrast_%d", F.col("p_size") % 7, "p_partkey")).alias("feature"))
    return names.mapping_coverage(names.map_features(b, a)).select("total_a", "total_b", "mapped_a", "mapped_b")


@query("fun_12_greenlist", """
  WITH f AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cell' ELSE 'nuclei' END AS o, p_size % 5 AS c, CASE p_partkey % 4 WHEN 0 THEN 'Intensity_Mean' WHEN 1 THEN 'Area' WHEN 2 THEN 'HuMoment_1' ELSE 'Entropy' END AS core FROM part)
  SELECT p_partkey, o || '_' || c || '/max/some_branch' || core AS full_feature_name FROM f
  WHERE (o = 'cell' AND c = 0 AND core = 'Intensity_Mean') OR (o = 'nuclei' AND core = 'Area')""")
def _(t):
    obj = F.when(F.col("p_size") % 2 == 0, "cell").otherwise("nuclei")
    core = word("p_partkey", ["Intensity_Mean", "Area", "HuMoment_1", "Entropy"])
    rows = t.part.select("p_partkey", F.concat(obj, F.lit("_"), (F.col("p_size") % 5).cast("string"), F.lit("/max/some_branch"), core).alias("full_feature_name"))
    green = t.spark.createDataFrame([("cell", "0_Intensity_Mean"), ("nuclei", "Area"), ("cell", "HuMoment_1")], "object string, feature string")
    return names.greenlist_filter(rows, green)


@query("fun_13_arithmetic", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity) * abs(l_tax - l_discount), 6) AS a, round(greatest(l_tax - l_discount, 0), 6) AS b,
   CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.sqrt("l_quantity") * F.abs(F.col("l_tax") - F.col("l_discount"))).alias("a"),
        r6(F.greatest(F.col("l_tax") - F.col("l_discount"), F.lit(0.0))).alias("b"),
        r6(safe_ratio(F.col("l_tax"), F.col("l_discount"))).alias("ratio"))


@query("fun_14_dice_from_iou", "SELECT event_id, round(2 * (value / 200) / (1 + value / 200), 6) AS dice FROM events")
def _(t):
    return t.events.select("event_id", r6(dice_from_iou(F.col("value") / 200)).alias("dice"))


@query("fun_15_normal_quantile", "SELECT event_id, round(" + normal_quantile_sql("((event_id + 0.5::DOUBLE) / 1e6::DOUBLE)") + ", 6) AS z FROM events")
def _(t):
    rows = t.events.select("event_id", ((F.col("event_id") + 0.5) / 1e6).alias("p"))
    return with_normal_quantile(rows, "p", "z").select("event_id", r6("z").alias("z"))


@query("fun_16_digests", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("fun_17_object_keys", """WITH {site_index}
  SELECT site, 'profiles/modelA/' || plate || '/' || source || '/' || batch || '/' || plate || '/' || concat_ws('__', source, batch, plate, well, site) || '.parquet' AS object_key FROM site_index""")
def _(t):
    keyed = t.site_index.withColumn("k", F.concat_ws("__", "source", "batch", "plate", "well", "site"))
    return keyed.select("site", object_key("k", F.lit("modelA"), F.col("plate")).alias("object_key"))
