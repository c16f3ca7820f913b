"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import relational as rel


def meta_profiles(t):
    """Profiles with prefixed metadata columns."""
    return rel.add_prefix(t.profiles, ["plate", "compound", "well", "grp", "negcon", "row_id"])


@query("prj_01_infer_columns", """WITH {profiles}
  SELECT round(avg(f0), 6) AS f0, round(avg(f1), 6) AS f1, round(avg(f2), 6) AS f2, round(avg(f3), 6) AS f3,
         6 AS n_meta FROM profiles""")
def _(t):
    df = meta_profiles(t)
    features, meta = rel.infer_columns(df)
    return df.agg(*[r6(F.avg(c)).alias(c) for c in features], F.lit(len(meta)).alias("n_meta"))


@query("prj_02_numeric_features", """
  SELECT round(max(l_quantity), 4) AS l_quantity, round(max(l_discount), 4) AS l_discount,
         max(l_partkey) AS l_partkey FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_returnflag", "l_discount", "l_partkey", "l_shipdate")
    return df.agg(*[F.max(c).alias(c) for c in rel.numeric_columns(df)])


@query("prj_03_regex_columns", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders")
def _(t):
    return rel.select_matching(t.orders, "^o_order(key|date|status)$")


@query("prj_04_exclude", "SELECT * EXCLUDE (p_name, p_size) FROM part")
def _(t):
    return t.part.drop("p_name", "p_size")


@query("prj_05_column_order", "SELECT c_mktsegment, c_custkey, c_name FROM customer")
def _(t):
    return rel.order_columns(t.customer, ["c_mktsegment", "not_there", "c_custkey", "c_name"])


@query("prj_06_rename_prefix", """
  SELECT s_suppkey AS "Metadata_s_suppkey", s_name AS "Metadata_s_name", s_acctbal AS balance, s_nationkey FROM supplier""")
def _(t):
    return rel.add_prefix(t.supplier.withColumnsRenamed({"s_acctbal": "balance"}), ["s_suppkey", "s_name"])


@query("prj_07_count_baseline", """WITH {eav}
  SELECT well, CAST(count(DISTINCT CASE WHEN object = 'cell' THEN label END) AS DOUBLE) AS n_cell,
         CAST(count(DISTINCT CASE WHEN object = 'nuclei' THEN label END) AS DOUBLE) AS n_nuclei,
         'cell_count' AS "Metadata_model" FROM eav GROUP BY well""")
def _(t):
    counts = t.eav.groupBy("well").agg(
        F.countDistinct(F.when(F.col("object") == "cell", F.col("label"))).alias("n_cell"),
        F.countDistinct(F.when(F.col("object") == "nuclei", F.col("label"))).alias("n_nuclei"),
    )
    return counts.select("well", F.col("n_cell").cast("double").alias("n_cell"),
                         F.col("n_nuclei").cast("double").alias("n_nuclei"),
                         F.lit("cell_count").alias("Metadata_model"))


@query("prj_09_control_flag", """
  SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'poscon' WHEN s_suppkey IN (1, 2, 3) THEN 'negcon' ELSE 'trt' END AS ctype,
         (CASE WHEN s_acctbal < 0 THEN 'poscon' WHEN s_suppkey IN (1, 2, 3) THEN 'negcon' ELSE 'trt' END) = 'negcon' AS is_neg
  FROM supplier""")
def _(t):
    df = t.supplier.withColumn("ctype", F.when(F.col("s_acctbal") < 0, "poscon"))
    return rel.control_flag(df, "ctype", "s_suppkey", [1, 2, 3], out="is_neg").select("s_suppkey", "ctype", "is_neg")


@query("prj_10_perturbation_type", """
  SELECT p_partkey, CASE WHEN p_type IS NULL OR p_type NOT IN ('SMALL', 'PROMO', 'LARGE') THEN 'compound'
         ELSE lower(p_type) END AS ptype FROM part""")
def _(t):
    known = F.col("p_type").isin("SMALL", "PROMO", "LARGE")
    return t.part.select("p_partkey", F.when(known, F.lower("p_type")).otherwise("compound").alias("ptype"))


@query("prj_11_group_label", """
  SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'group_high' WHEN c_nationkey < 5 THEN 'group_low'
         WHEN c_nationkey IN (7, 8) THEN 'orf' WHEN c_nationkey = 9 THEN 'crispr' ELSE 'other' END AS grp FROM customer""")
def _(t):
    label = rel.choose([(F.col("c_mktsegment") == "BUILDING", "group_high"), (F.col("c_nationkey") < 5, "group_low"),
                        (F.col("c_nationkey").isin(7, 8), "orf"), (F.col("c_nationkey") == 9, "crispr")], "other")
    return t.customer.select("c_custkey", label.alias("grp"))


@query("prj_12_disjunctive_filter", """
  SELECT event_id FROM events WHERE value > 90 OR user_id < 3 OR event_type NOT IN ('click', 'view', 'error', 'purchase')
   OR regexp_matches(event_type, '(?i)ERR')""")
def _(t):
    return t.events.filter((F.col("value") > 90) | (F.col("user_id") < 3)
                           | ~F.col("event_type").isin("click", "view", "error", "purchase")
                           | F.col("event_type").rlike("(?i)ERR")).select("event_id")


@query("prj_13_plate_redlist", """
  SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND suffix(c_name, '7'))
   OR (c_mktsegment = 'MACHINERY' AND regexp_matches(c_name, '^Customer#0+[23]'))
   OR (c_mktsegment = 'HOUSEHOLD' AND c_nationkey IN (2, 4))""")
def _(t):
    seg = F.col("c_mktsegment")
    red = ((seg == "BUILDING") & F.col("c_name").endswith("7")) \
        | ((seg == "MACHINERY") & F.col("c_name").rlike("^Customer#0+[23]")) \
        | ((seg == "HOUSEHOLD") & F.col("c_nationkey").isin(2, 4))
    return t.customer.filter(red).select("c_custkey")


@query("prj_14_ilike_exclusion", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey NOT IN
  (SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%')""")
def _(t):
    out = t.part.filter(F.col("p_name").ilike("%RED%")).select(F.col("p_partkey").alias("l_partkey"))
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .join(out, "l_partkey", "left_anti"))


# A fixed exclusion list is a table with a reason per entry.
EXCLUDED_BATCHES = [("O", "B1995", "incomplete imaging"), ("F", "B1996", "wrong stain"), ("P", "B1997", "duplicate run")]


@query("prj_15_exclusion_list", """
  SELECT o_orderkey FROM orders WHERE (o_orderstatus, 'B' || year(o_orderdate)) NOT IN
  (('O', 'B1995'), ('F', 'B1996'), ('P', 'B1997'))""")
def _(t):
    listed = t.spark.createDataFrame(EXCLUDED_BATCHES, "o_orderstatus string, batch string, reason string")
    orders = t.orders.withColumn("batch", F.concat(F.lit("B"), F.year("o_orderdate").cast("string")))
    return orders.join(F.broadcast(listed), ["o_orderstatus", "batch"], "left_anti").select("o_orderkey")


@query("prj_16_null_aware_panel", """WITH {runs}
  SELECT family, codec, config, pa FROM runs WHERE modality IS NULL AND family = 'BUILDING'""")
def _(t):
    return rel.filter_panel(t.runs, modality=None, family="BUILDING").select("family", "codec", "config", "pa")


@query("prj_17_literal_tags", """
  SELECT r_regionkey, r_name, 'modelA' AS "Metadata_model", 'full' AS "Metadata_dataset", 'none' AS "Metadata_compression"
  FROM region""")
def _(t):
    return rel.tag(t.region, Metadata_model="modelA", Metadata_dataset="full", Metadata_compression="none")


@query("prj_18_restrict_to_split", """
  SELECT p_partkey, p_type FROM part WHERE p_type <> 'SMALL' OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax >= 0.08)""")
def _(t):
    split = t.lineitem.filter("l_tax >= 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return rel.restrict_to_split(t.part.select("p_partkey", "p_type"), F.col("p_type") == "SMALL", split, "p_partkey")


@query("prj_19_named_groups", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("prj_20_nearest_threshold", """
  SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount =
  (SELECT l_discount FROM lineitem ORDER BY abs(l_discount - 0.043), l_discount LIMIT 1)""")
def _(t):
    near = rel.nearest_threshold(t.lineitem, 0.043, "l_discount")
    return near.filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_partkey", "l_discount")


@query("prj_21_percentile_band", """
  SELECT c_custkey, c_acctbal FROM customer, (SELECT quantile_cont(c_acctbal, 0.1) lo, quantile_cont(c_acctbal, 0.9) hi FROM customer)
  WHERE c_acctbal BETWEEN lo AND hi""")
def _(t):
    return rel.percentile_band(t.customer, "c_acctbal", 0.1, 0.9).select("c_custkey", "c_acctbal")


@query("prj_22_outlier_list", """WITH {runs}
  SELECT family, codec, config, round(pa - pc * 100, 4) AS diff FROM runs WHERE abs(pa - pc * 100) > 10""")
def _(t):
    diff = F.col("pa") - F.col("pc") * 100
    return (t.runs.filter(F.abs(diff) > 10).select("family", "codec", "config", r6(diff, 4).alias("diff"))
            .orderBy(F.abs("diff").desc()))


@query("prj_23_include_exclude", """WITH {runs}
  SELECT family, codec, config FROM runs WHERE family IN ('BUILDING', 'FURNITURE') AND codec NOT IN ('codec3')""")
def _(t):
    return (t.runs.filter(F.col("family").isin("BUILDING", "FURNITURE") & ~F.col("codec").isin("codec3"))
            .select("family", "codec", "config"))


@query("prj_24_degenerate_configs", """WITH {runs}
  SELECT family, codec, config FROM runs WHERE NOT (codec = 'codec1' AND family <> 'BUILDING')""")
def _(t):
    whitened_without_pca = (F.col("codec") == "codec1") & (F.col("family") != "BUILDING")
    return t.runs.filter(~whitened_without_pca).select("family", "codec", "config")


@query("prj_25_min_count_gate", """
  SELECT event_id, user_id, event_type FROM events WHERE (user_id, event_type) IN
   (SELECT (user_id, event_type) FROM events GROUP BY user_id, event_type HAVING count(*) >= 14)""")
def _(t):
    return rel.min_group_size(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 14)


@query("prj_26_annotation_projection", """WITH {annotations}
  SELECT DISTINCT compound, target, mode FROM annotations""")
def _(t):
    df = rel.require_columns(t.annotations, ["compound", "target", "mode"])
    return df.select("compound", "target", "mode").distinct()
