"""Joins."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import relational as rel
from phenospark.operators.aggregate import sorted_unique_join
from phenospark.operators.stats import match_objects


@query("jon_01_merge_metadata", """
  WITH m AS (SELECT o_custkey, min((o_orderpriority, o_orderstatus)) AS r FROM orders GROUP BY o_custkey)
  SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_acctbal, r[1] AS o_orderpriority, r[2] AS note
  FROM customer JOIN m ON c_custkey = o_custkey""")
def _(t):
    left = t.customer.select(F.col("c_custkey").alias("custkey"), "c_acctbal", F.lit("old").alias("note"))
    right = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderpriority", F.col("o_orderstatus").alias("note"))
    return rel.enrich(left, right, ["custkey"], how="inner", prefer="right")


@query("jon_02_left_on_existing_keys", """
  SELECT s_suppkey AS suppkey, CAST(s_nationkey AS VARCHAR) AS nationkey, s_name, n_name
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3""")
def _(t):
    left = t.supplier.select(F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nationkey"), "s_name")
    right = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return rel.enrich(left, right, ["batch", "nationkey", "site"])


@query("jon_03_left_new_columns_only", """
  SELECT CAST(p_partkey AS VARCHAR) AS compound, p_name, n_rows FROM part
  LEFT JOIN (SELECT l_partkey, count(*) AS n_rows FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey""")
def _(t):
    left = t.part.select(F.col("p_partkey").alias("compound"), "p_name")
    right = (t.lineitem.filter("l_quantity > 40").groupBy(F.col("l_partkey").alias("compound"))
             .agg(F.count("*").alias("n_rows"), F.lit("x").alias("p_name")))
    return rel.enrich(left, right, ["compound"])


@query("jon_04_wells_on_plates", """
  SELECT l_orderkey, l_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def _(t):
    ids = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    plates = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return (t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(plates, "l_suppkey")
            .join(ids, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "s_name"))


@query("jon_05_connectivity_key", """
  SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, split_part(c_name, '#', 2) AS k FROM customer)
  LEFT JOIN (SELECT s_suppkey, split_part(s_name, '#', 2) AS k FROM supplier) USING (k)""")
def _(t):
    layer = lambda c: F.split_part(F.col(c), F.lit("#"), F.lit(2)).alias("k")
    return (t.customer.select("c_custkey", layer("c_name"))
            .join(t.supplier.select("s_suppkey", layer("s_name")), "k", "left").select("c_custkey", "s_suppkey"))


@query("jon_06_anti_union", """
  SELECT DISTINCT plate, well FROM (SELECT l_suppkey AS plate, l_partkey % 96 AS well FROM lineitem) a
  WHERE NOT EXISTS (SELECT 1 FROM (
     SELECT l_suppkey AS plate, l_partkey % 96 AS well FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.1
     UNION ALL SELECT l_suppkey, l_partkey % 96 FROM lineitem WHERE l_quantity = 50) b
     WHERE a.plate = b.plate AND a.well = b.well)""")
def _(t):
    keyed = lambda df: df.select(F.col("l_suppkey").alias("plate"), (F.col("l_partkey") % 96).alias("well"))
    red = keyed(t.lineitem.filter("l_tax = 0.08 AND l_discount = 0.1"))
    gray = keyed(t.lineitem.filter("l_quantity = 50"))
    return keyed(t.lineitem).distinct().join(red.unionByName(gray), ["plate", "well"], "left_anti")


@query("jon_07_positional_key", """
  SELECT o_orderkey, o_orderstatus FROM orders JOIN (SELECT DISTINCT #2 AS o_custkey FROM (SELECT l_orderkey, l_suppkey FROM lineitem))
  USING (o_custkey)""")
def _(t):
    listing = t.lineitem.select("l_orderkey", "l_suppkey")
    keys = listing.select(F.col(listing.columns[1]).alias("o_custkey")).distinct()
    return t.orders.join(keys, "o_custkey").select("o_orderkey", "o_orderstatus")


@query("jon_08_release_semi_joins", """
  SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))""")
def _(t):
    released = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    wells = t.lineitem.select("l_orderkey", "l_partkey").join(released, "l_orderkey", "left_semi")
    return (t.part.select("p_partkey", "p_name")
            .join(wells.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi"))


@query("jon_09_one_to_one_check", """
  SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS one_to_one
  FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderkey").alias("n_keys")) \
        .withColumn("one_to_one", F.col("n_rows") == F.col("n_keys"))


@query("jon_10_counts_to_detail", """WITH {annotations}
  SELECT compound, target, support,
    nullif(count(CASE WHEN support >= 5 THEN 1 END) OVER (PARTITION BY compound), 0) AS cmp_geq5,
    count(*) OVER (PARTITION BY compound) AS cmp_all,
    nullif(count(CASE WHEN support >= 5 THEN 1 END) OVER (PARTITION BY target), 0) AS tgt_geq5,
    count(*) OVER (PARTITION BY target) AS tgt_all FROM annotations""")
def _(t):
    from phenospark.operators.curate import interaction_counts

    out = interaction_counts(t.annotations, "compound", "target", "support", 5)
    return out.select("compound", "target", "support", "cmp_geq5", "cmp_all", "tgt_geq5", "tgt_all")


@query("jon_11_direction_match", """WITH {annotations}, g AS (
    SELECT DISTINCT 'T' || (s_suppkey * 5 % 500) AS symbol, CASE WHEN s_nationkey % 2 = 0 THEN 'crispr' ELSE 'orf' END AS modality FROM supplier)
  SELECT a.compound, a.target, a.mode, g.modality, 'matched' AS how FROM annotations a JOIN g ON a.target = g.symbol
    AND a.mode = CASE g.modality WHEN 'crispr' THEN 'inhibition' ELSE 'activation' END
  UNION ALL SELECT a.compound, a.target, a.mode, g.modality, 'undirected' FROM annotations a JOIN g ON a.target = g.symbol
  WHERE a.mode = 'unspecified'""")
def _(t):
    from phenospark.operators.curate import match_directions

    return match_directions(t.annotations, gene_table(t), "target", "mode", "symbol", "modality")


def gene_table(t):
    """Gene perturbations: symbol and modality."""
    return t.supplier.select(
        F.concat(F.lit("T"), (F.col("s_suppkey") * 5 % 500).cast("string")).alias("symbol"),
        F.when(F.col("s_nationkey") % 2 == 0, "crispr").otherwise("orf").alias("modality")).distinct()


@query("jon_12_shared_target_pairs", """WITH {edges}
  SELECT DISTINCT x.compound AS a, y.compound AS b FROM edges x JOIN edges y ON x.target = y.target AND x.compound <> y.compound""")
def _(t):
    return rel.pairs_in_group(t.edges, ["target"], "compound")


@query("jon_13_shared_target_and_action", """WITH {edges}
  SELECT DISTINCT x.compound AS a, y.compound AS b FROM edges x JOIN edges y
  ON x.target = y.target AND x.rel_type = y.rel_type AND x.compound <> y.compound""")
def _(t):
    return rel.pairs_in_group(t.edges, ["target", "rel_type"], "compound")


@query("jon_14_double_lookup", """
  SELECT a.n_name AS name_a, b.n_name AS name_b, count(*) AS n FROM
   (SELECT DISTINCT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
   JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey
   JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY ALL""")
def _(t):
    ends = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select("l_suppkey", "o_custkey").distinct())
    look = lambda df, key, name: (df.join(t.nation, F.col(df.columns[1]) == F.col("n_nationkey"))
                                  .select(F.col(df.columns[0]).alias(key), F.col("n_name").alias(name)))
    a = look(t.supplier.select("s_suppkey", "s_nationkey"), "l_suppkey", "name_a")
    b = look(t.customer.select("c_custkey", "c_nationkey"), "o_custkey", "name_b")
    return ends.join(a, "l_suppkey").join(b, "o_custkey").groupBy("name_a", "name_b").agg(F.count("*").alias("n"))


@query("jon_15_null_safe_join", """WITH {runs}
  SELECT a.family, a.config, a.modality, a.codec AS codec, round(a.pa - b.pa, 6) AS d FROM runs a JOIN runs b
  ON a.family = b.family AND a.config = b.config AND a.modality IS NOT DISTINCT FROM b.modality
  WHERE b.codec IN ('codec0', 'codec2')""")
def _(t):
    base = (t.runs.filter(F.col("codec").isin("codec0", "codec2"))
            .select("family", "config", "modality", F.col("pa").alias("base_pa")))
    joined = rel.null_safe_join(t.runs, base, ["family", "config", "modality"])
    return joined.select("family", "config", "modality", "codec", r6(F.col("pa") - F.col("base_pa")).alias("d"))


@query("jon_16_pinned_with_fallback", """WITH {runs},
  pin AS (SELECT family, max_by(config, (pa, config)) AS config FROM runs WHERE codec = 'codec0' GROUP BY family),
  hit AS (SELECT r.family, r.codec, r.config, r.pa FROM runs r JOIN pin p ON r.family = p.family AND r.config = p.config),
  rest AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.family = r.family AND h.codec = r.codec))
  SELECT family, codec, config, pa FROM hit UNION ALL
  SELECT family, codec, max_by(config, (pa, config)), max(pa) FROM rest GROUP BY family, codec""")
def _(t):
    from phenospark.operators.results import pinned_config

    return pinned_config(t.runs, "family", "codec", "config", "pa", "codec0").select("family", "codec", "config", "pa")


@query("jon_17_task_means_in_one_row", """
  SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS click,
   round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS view,
   round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS error,
   round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS purchase FROM events GROUP BY user_id""")
def _(t):
    means = [r6(F.avg(F.when(F.col("event_type") == k, F.col("value")))).alias(k)
             for k in ("click", "view", "error", "purchase")]
    return t.events.groupBy("user_id").agg(*means)


@query("jon_18_matched_objects", """WITH {masks}, m AS (
   SELECT DISTINCT site, gt_id, pred_id FROM masks WHERE gt_id > 0 AND pred_id > 0),
   v AS (SELECT user_id AS site, event_id % 7 AS label, avg(value) AS x FROM events GROUP BY ALL)
  SELECT m.site, gt_id, pred_id, round(a.x, 6) AS x_gt, round(b.x, 6) AS x_pred FROM m
  JOIN v a ON a.site = m.site AND a.label = m.gt_id JOIN v b ON b.site = m.site AND b.label = m.pred_id""")
def _(t):
    mapping = t.masks.filter("gt_id > 0 AND pred_id > 0").select("site", "gt_id", "pred_id").distinct()
    v = t.events.groupBy(F.col("user_id").alias("site"), (F.col("event_id") % 7).alias("label")).agg(F.avg("value").alias("x"))
    found = match_objects(v, v, mapping, "site", "gt_id", "pred_id", ("x",))
    return found.select("site", "gt_id", "pred_id", r6("x_a").alias("x_gt"), r6("x_b").alias("x_pred"))


@query("jon_19_interior_objects", """WITH {eav}, o AS (
   SELECT well, site, label, max(value) AS hi FROM eav GROUP BY ALL)
  SELECT e.well, e.site, e.label, e.metric, round(e.value, 6) AS value FROM eav e WHERE EXISTS (
    SELECT 1 FROM o WHERE o.well = e.well AND o.site = e.site AND o.label = e.label AND o.hi < 50)""")
def _(t):
    keys = ["well", "site", "label"]
    interior = t.eav.groupBy(*keys).agg(F.max("value").alias("hi")).filter("hi < 50")
    return t.eav.join(interior, keys, "left_semi").select(*keys, "metric", r6("value").alias("value"))


@query("jon_20_border_filter", """WITH {eav}, box AS (
   SELECT well, site, label, max(CASE WHEN metric = 'click' THEN value END) AS x_max,
     max(CASE WHEN metric = 'view' THEN value END) AS y_max FROM eav GROUP BY ALL),
   ext AS (SELECT well, site, max(x_max) AS w, max(y_max) AS h FROM box GROUP BY ALL)
  SELECT well, site, label FROM box JOIN ext USING (well, site) WHERE x_max < w AND y_max < h""")
def _(t):
    from phenospark.operators.reshape import interior_objects

    return interior_objects(t.eav, ["well", "site"], "label", "metric", "value", x_metric="click", y_metric="view")


@query("jon_21_outer_results", """
  SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM
  (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a FULL JOIN
  (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 2000 GROUP BY 1) b ON a.k = b.k""")
def _(t):
    a = t.customer.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_cust"))
    b = t.supplier.filter("s_acctbal > 2000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_supp"))
    return a.join(b, "k", "outer")


@query("jon_22_refresh_columns", """WITH {runs}
  SELECT family, codec, config, pa, CASE WHEN codec = 'codec1' THEN round(pc * 2, 6) END AS pc, n, modality FROM runs""")
def _(t):
    fresh = t.runs.filter("codec = 'codec1'").select("family", "codec", "config", r6(F.col("pc") * 2).alias("pc"))
    return rel.refresh_columns(t.runs, fresh, ["family", "codec", "config"])


@query("jon_25_profiles_to_metadata_wells", """WITH {profiles}
  SELECT concat_ws('__', plate, well, compound) AS "Metadata_id", plate, well, compound, f0 FROM profiles
  WHERE compound IN (SELECT p_partkey FROM part WHERE p_size >= 25)""")
def _(t):
    wells = t.part.filter("p_size >= 25").select(F.col("p_partkey").alias("compound"))
    return (t.profiles.join(wells, "compound")
            .select(F.concat_ws("__", "plate", "well", "compound").alias("Metadata_id"), "plate", "well", "compound", "f0"))


@query("jon_26_metadata_times_sites", """
  SELECT s_suppkey, s_name, site FROM supplier CROSS JOIN (SELECT DISTINCT l_linenumber AS site FROM lineitem)""")
def _(t):
    sites = t.lineitem.agg(F.sort_array(F.collect_set("l_linenumber")).alias("sites"))
    # The distinct sites are a handful of numbers: one broadcast row, exploded next to each well.
    return (t.supplier.select("s_suppkey", "s_name").join(F.broadcast(sites))
            .select("s_suppkey", "s_name", F.explode("sites").alias("site")))


@query("jon_27_distinct_enrichment", """
  SELECT o_orderkey, l_returnflag, l_linestatus FROM orders LEFT JOIN
  (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey""")
def _(t):
    extra = (t.lineitem.filter("l_quantity > 45")
             .select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus").distinct())
    return t.orders.select("o_orderkey").join(extra, "o_orderkey", "left")


@query("jon_28_target_list", """WITH {annotations}
  SELECT p_partkey AS compound, p_name, targets FROM part LEFT JOIN
  (SELECT compound, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM annotations WHERE target_type = 'gene' GROUP BY 1)
  ON compound = p_partkey""")
def _(t):
    lists = (t.annotations.filter("target_type = 'gene'").groupBy("compound")
             .agg(sorted_unique_join("target").alias("targets")))
    return t.part.select(F.col("p_partkey").alias("compound"), "p_name").join(lists, "compound", "left")


@query("jon_29_feature_tables", """WITH {profiles}, {plong},
  a AS (SELECT feature, avg(v) AS m FROM plong WHERE grp = 'g0' GROUP BY 1), b AS (SELECT feature, avg(v) AS m FROM plong WHERE grp = 'g1' GROUP BY 1)
  SELECT feature, round(a.m, 5) AS m0, round(b.m, 5) AS m1 FROM a JOIN b USING (feature)""")
def _(t):
    long = t.profiles.unpivot(["grp"], ["f0", "f1", "f2", "f3"], "feature", "v")
    mean = lambda g, n: long.filter(F.col("grp") == g).groupBy("feature").agg(r6(F.avg("v"), 5).alias(n))
    return mean("g0", "m0").join(mean("g1", "m1"), "feature")
