"""Aggregations and reshaping."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import aggregate as agg
from phenospark.operators import relational as rel
from phenospark.operators import reshape as rs
from phenospark.operators.frame import ProfileFrame

FEATS = ["f0", "f1", "f2", "f3"]
METRICS = ["click", "error", "purchase", "signup", "view"]


def frame(t) -> ProfileFrame:
    return ProfileFrame.from_wide(t.profiles, FEATS)


def rounded(df, cols, digits=6):
    return df.withColumns({c: r6(c, digits) for c in cols})


@query("agg_01_aggregate_wells_median", """WITH {profiles}
  SELECT plate, well, round(median(f0), 8) AS f0, round(median(f1), 8) AS f1, round(median(f2), 8) AS f2,
    round(median(f3), 8) AS f3, min_by(compound, row_id) AS compound FROM profiles GROUP BY plate, well""")
def _(t):
    out = agg.aggregate_profiles(frame(t), ["plate", "well"], "median")
    return rounded(out.wide().select("plate", "well", *FEATS, "compound"), FEATS, 8)


@query("agg_01_aggregate_wells_mean", """WITH {profiles}
  SELECT plate, grp, round(avg(f0), 6) AS f0, round(avg(f1), 4) AS f1, round(avg(f2), 6) AS f2,
    round(avg(f3), 6) AS f3 FROM profiles GROUP BY plate, grp""")
def _(t):
    out = agg.aggregate_profiles(frame(t), ["plate", "grp"], "mean").wide().select("plate", "grp", *FEATS)
    return rounded(out, ["f0", "f2", "f3"]).withColumn("f1", r6("f1", 4))




@query("agg_02_eav_median", """WITH {eav}
  SELECT well, object, branch || '_' || metric AS feature, round(median(value), 6) AS value FROM eav GROUP BY ALL""")
def _(t):
    out = rs.well_medians(t.eav, ["well", "object"], F.concat_ws("_", "branch", "metric"))
    return rounded(out, ["value"])


@query("agg_03_wide_means", """
  SELECT o_custkey, round(avg(o_totalprice), 4) AS o_totalprice, round(avg(o_orderkey), 6) AS o_orderkey FROM orders GROUP BY 1""")
def _(t):
    out = rs.wide_to_wells(t.orders, ["o_custkey"])
    return out.select("o_custkey", r6("o_totalprice", 4).alias("o_totalprice"), r6("o_orderkey").alias("o_orderkey"))


@query("agg_04_site_means", """WITH {eav}
  SELECT tp, site, branch, metric, object, round(avg(value), 6) AS value FROM eav GROUP BY ALL""")
def _(t):
    return t.eav.groupBy("tp", "site", "branch", "metric", "object").agg(r6(F.avg("value")).alias("value"))


@query("agg_05_conditional_distinct", """WITH {eav}
  SELECT well, count(DISTINCT CASE WHEN object = 'cell' THEN label END) AS n_cell,
   count(DISTINCT CASE WHEN object = 'nuclei' THEN (site, label) END) AS n_nuclei_per_site FROM eav GROUP BY well""")
def _(t):
    return t.eav.groupBy("well").agg(
        F.countDistinct(F.when(F.col("object") == "cell", F.col("label"))).alias("n_cell"),
        F.countDistinct(F.when(F.col("object") == "nuclei", F.struct("site", "label"))).alias("n_nuclei_per_site"))


@query("agg_06_count_by_one_metric", """WITH {eav}
  SELECT site, count(*) FILTER (WHERE object = 'cell') AS cell, count(*) FILTER (WHERE object = 'nuclei') AS nuclei
  FROM eav WHERE metric = 'click' GROUP BY site""")
def _(t):
    return (t.eav.filter("metric = 'click'").groupBy("site").pivot("object", ["cell", "nuclei"]).agg(F.count(F.lit(1))))


@query("agg_07_bounding_box", """WITH {eav}
  SELECT well, site, label, round(max(CASE WHEN metric = 'click' THEN value END), 6) AS x_max,
    round(max(CASE WHEN metric = 'view' THEN value END), 6) AS y_max FROM eav WHERE metric IN ('click', 'view') GROUP BY ALL""")
def _(t):
    out = rs.bounding_boxes(t.eav, ["well", "site"], "label", "metric", "value", "click", "view")
    return rounded(out, ["x_max", "y_max"])


@query("agg_08_extent", """WITH {eav}
  SELECT well, site, round(max(m), 6) AS extent FROM (SELECT well, site, label, max(value) AS m FROM eav GROUP BY ALL) GROUP BY ALL""")
def _(t):
    return t.eav.groupBy("well", "site").agg(r6(F.max("value")).alias("extent"))


@query("agg_09_consensus", """WITH {profiles}, p AS (SELECT *, CASE WHEN compound % 50 <> 0 THEN compound END AS cmp FROM profiles)
  SELECT cmp, grp, round(median(f0), 8) AS f0, round(median(f1), 8) AS f1, round(median(f2), 8) AS f2, round(median(f3), 8) AS f3
  FROM p WHERE cmp IS NOT NULL GROUP BY cmp, grp""")
def _(t):
    df = t.profiles.withColumn("cmp", F.when(F.col("compound") % 50 != 0, F.col("compound")))
    out = agg.aggregate_profiles(ProfileFrame.from_wide(df, FEATS), ["cmp", "grp"], "median", drop_null_keys=True)
    return rounded(out.wide().select("cmp", "grp", *FEATS), FEATS, 8)


@query("agg_10_sorted_unique_strings", """WITH {annotations}
  SELECT compound, string_agg(DISTINCT target, '|' ORDER BY target) AS targets FROM annotations GROUP BY compound""")
def _(t):
    return t.annotations.groupBy("compound").agg(agg.sorted_unique_join("target").alias("targets"))


@query("agg_11_plate_fill_rate", """WITH {profiles}, r AS (
   SELECT plate, round(count(DISTINCT well) * 1.0::DOUBLE / 96 * 100, 2) AS fill_rate FROM profiles GROUP BY plate)
  SELECT p.row_id, r.fill_rate FROM profiles p JOIN r USING (plate) WHERE r.fill_rate >= 99""")
def _(t):
    from phenospark.operators.curate import filter_fill_rate

    return filter_fill_rate(t.profiles, ["plate"], "well", 99, capacity=96).select("row_id", "fill_rate")


@query("agg_12_min_replicates", """WITH {profiles}
  SELECT compound FROM profiles WHERE plate % 3 <> 0 GROUP BY compound HAVING count(*) >= 18""")
def _(t):
    from phenospark.operators.curate import min_replicates

    return min_replicates(t.profiles, "compound", 18, F.col("plate") % 3 != 0)


@query("agg_13_plate_manifest", """WITH {site_index}
  SELECT source, batch, plate, count(DISTINCT well) AS n_wells, count(*) AS n_sites FROM site_index GROUP BY ALL""")
def _(t):
    return t.site_index.groupBy("source", "batch", "plate").agg(
        F.countDistinct("well").alias("n_wells"), F.count("*").alias("n_sites"))


@query("agg_14_filtered_counts", """
  SELECT count(*) FILTER (WHERE l_quantity > 25) AS n_big, count(*) FILTER (WHERE l_tax IS NULL) AS n_null,
   count(DISTINCT l_partkey) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)) AS n_unknown FROM lineitem""")
def _(t):
    known = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    counts = t.lineitem.agg(F.count_if(F.col("l_quantity") > 25).alias("n_big"),
                            F.count_if(F.col("l_tax").isNull()).alias("n_null"))
    unknown = t.lineitem.join(known, "l_partkey", "left_anti").agg(F.countDistinct("l_partkey").alias("n_unknown"))
    return counts.join(F.broadcast(unknown))


@query("agg_15_group_summary", """WITH {runs}
  SELECT family, round(avg(CASE WHEN pa > 4000 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_active,
   count(*) FILTER (WHERE pa > 4000) AS n_active, round(avg(pa), 6) AS mean_pa, round(median(pa), 6) AS median_pa,
   round(avg(greatest(pa, 0)), 6) AS mean_clipped, count(DISTINCT config) AS n_unique FROM runs GROUP BY family""")
def _(t):
    active = F.col("pa") > 4000
    stats = t.runs.groupBy("family").agg(
        r6(F.avg(active.cast("double")) * 100).alias("pct_active"), F.count_if(active).alias("n_active"),
        r6(F.avg("pa")).alias("mean_pa"), r6(F.avg(F.greatest("pa", F.lit(0.0)))).alias("mean_clipped"),
        F.countDistinct("config").alias("n_unique"))
    med = agg.group_median(t.runs, ["family"], "pa", "median_pa")
    return stats.join(rounded(med, ["median_pa"]), "family")


@query("agg_16_result_summary", """WITH {runs}
  SELECT family, codec, count(*) AS n, round(max(pa), 6) AS best, round(avg(pa), 6) AS mean FROM runs GROUP BY ALL""")
def _(t):
    return t.runs.groupBy("family", "codec").agg(
        F.count("*").alias("n"), r6(F.max("pa")).alias("best"), r6(F.avg("pa")).alias("mean"))


@query("agg_17_summary_statistics", """
  SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
   round(max(value), 6) AS max, round(quantile_cont(value, 0.05), 6) AS p05, round(median(value), 6) AS p50,
   round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def _(t):
    return rounded(agg.summarize(t.events, ["event_type"], "value"), ["mean", "std", "min", "max", "p05", "p50", "p95"])


@query("agg_18_mean_std_over_configs", """WITH {runs}
  SELECT family, codec, modality, round(avg(pa), 6) AS mean, round(stddev_samp(pa), 6) AS std, count(pa) AS n FROM runs GROUP BY ALL""")
def _(t):
    from phenospark.operators.results import codec_delta_summary

    return rounded(codec_delta_summary(t.runs, ["family", "codec", "modality"], "pa"), ["mean", "std"])


@query("agg_19_mean_over_seeds", """
  SELECT c_mktsegment AS model, c_nationkey AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY ALL""")
def _(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("n")).agg(
        r6(F.avg("c_acctbal")).alias("mean"), r6(F.stddev_samp("c_acctbal")).alias("std"))


@query("agg_20_cross_well_summary", """
  SELECT l_returnflag AS codec, l_linestatus AS feature, round(avg(l_quantity), 6) AS q_mean, round(median(l_quantity), 6) AS q_median,
   round(avg(l_tax), 6) AS t_mean, round(median(l_tax), 6) AS t_median FROM lineitem GROUP BY ALL""")
def _(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("codec"), F.col("l_linestatus").alias("feature"), "l_quantity", "l_tax")
    keys = ["codec", "feature"]
    out = li.groupBy(*keys).agg(r6(F.avg("l_quantity")).alias("q_mean"), r6(F.avg("l_tax")).alias("t_mean"))
    for c, n in (("l_quantity", "q_median"), ("l_tax", "t_median")):
        out = out.join(rounded(agg.group_median(li, keys, c, n), [n]), keys)
    return out


@query("agg_21_metric_per_threshold", """
  SELECT l_returnflag AS codec, threshold, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM
  (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME threshold VALUE v) GROUP BY ALL""")
def _(t):
    long = t.lineitem.unpivot([F.col("l_returnflag").alias("codec")], ["l_quantity", "l_discount", "l_tax"], "threshold", "v")
    return long.groupBy("codec", "threshold").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("std"))


@query("agg_22_surplus_by_source", """WITH {site_index}
  SELECT split_part(k, '__', 1) AS source, count(*) AS n FROM (SELECT source || '__' || batch || '__' || plate AS k FROM site_index) GROUP BY 1""")
def _(t):
    keys = t.site_index.select(F.concat_ws("__", "source", "batch", "plate").alias("k"))
    return keys.groupBy(F.split("k", "__")[0].alias("source")).agg(F.count("*").alias("n"))


DIGEST_SQL = "concat_ws('-', " + ", ".join(
    f"CAST(sum(CAST(('0x' || substr(d, {1 + 15 * i}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4)) + ")"


@query("agg_23_set_digest", """WITH {site_index}, k AS (SELECT DISTINCT source, sha256(concat_ws('__', source, batch, plate, well, site)) AS d FROM site_index)
  SELECT source, count(*) AS n, """ + DIGEST_SQL + """ AS digest FROM k GROUP BY source""")
def _(t):
    return agg.set_digest(t.site_index, F.concat_ws("__", "source", "batch", "plate", "well", "site"), ["source"])


@query("agg_24_pivoted_group_tables", """
  SELECT l_returnflag, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS "F", round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS "O"
  FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(r6(F.avg("l_tax")))


@query("agg_26_match_type_share", """
  SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS pct
  FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber""")
def _(t):
    out = agg.share(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    return rounded(out, ["pct"])


@query("agg_27_median_by_codec_and_group", """
  SELECT c_mktsegment AS codec, c_nationkey % 5 AS fgroup, round(median(c_acctbal), 6) AS p50, round(quantile_cont(c_acctbal, 0.25), 6) AS p25,
   round(quantile_cont(c_acctbal, 0.75), 6) AS p75 FROM customer GROUP BY ALL""")
def _(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("codec"), (F.col("c_nationkey") % 5).alias("fgroup"), "c_acctbal")
    return rounded(agg.group_quantiles(rows, ["codec", "fgroup"], "c_acctbal", [0.25, 0.5, 0.75], ["p25", "p50", "p75"]),
                   ["p25", "p50", "p75"])


# ---- reshape ---------------------------------------------------------------------------------

PIVOT_SQL = ", ".join(f"round(median(value) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in METRICS)


@query("rsh_01_long_to_wells", """WITH {eav}
  SELECT well, """ + PIVOT_SQL + """, count(DISTINCT CASE WHEN object = 'cell' THEN label END) AS n_cell,
   count(DISTINCT CASE WHEN object = 'nuclei' THEN label END) AS n_nuclei FROM eav GROUP BY well""")
def _(t):
    return rounded(rs.long_to_wells(t.eav, ["well"], F.col("metric"), METRICS), METRICS)


@query("rsh_02_pivot_object_metric", """WITH {eav}
  SELECT well, """ + ", ".join(
    f"round(median(value) FILTER (WHERE metric = '{m}' AND object = '{o}'), 6) AS {o}_{m}"
    for o in ("cell", "nuclei") for m in METRICS) + " FROM eav GROUP BY well")
def _(t):
    names = [f"{o}_{m}" for o in ("cell", "nuclei") for m in METRICS]
    cells = rs.well_medians(t.eav, ["well"], F.concat_ws("_", "object", "metric"))
    return rounded(rs.pivot_features(cells, ["well"], names), names)


@query("rsh_03_unpivot_channels", """WITH {site_index}
  SELECT source, plate, site, channel, uri FROM (UNPIVOT (SELECT source, plate, site, "URL_DNA", "URL_RNA" FROM site_index)
   ON COLUMNS('URL_*') INTO NAME channel VALUE uri)""")
def _(t):
    idx = t.site_index.select("source", "plate", "site", "URL_DNA", "URL_RNA")
    return rs.unpivot(idx, ["source", "plate", "site"], ["URL_DNA", "URL_RNA"], "channel", "uri")


@query("rsh_04_ordered_channels", """WITH {site_index}
  SELECT site, 0 AS channel_order, 'URL_DNA' AS channel, "URL_DNA" AS uri FROM site_index
  UNION ALL SELECT site, 1, 'URL_RNA', "URL_RNA" FROM site_index""")
def _(t):
    return rs.expand_channels(t.site_index, ["site"], ["URL_DNA", "URL_RNA"], "channel", "uri")


@query("rsh_05_object_features", """WITH {eav}, n AS (
   SELECT well, label, CASE WHEN regexp_matches(branch, '^[0-9]+/') THEN regexp_extract(branch, '^([0-9]+)/', 1) || '_' || metric ELSE metric END AS feature, value
   FROM eav WHERE object = 'cell')
  SELECT well, label, """ + ", ".join(
    f"""round(avg(value) FILTER (WHERE feature = '{f}'), 6) AS "{f}" """ for f in ["click", "0_click", "view", "0_view"]) + """
  FROM n WHERE feature IN ('click', '0_click', 'view', '0_view') GROUP BY well, label""")
def _(t):
    names = ["click", "0_click", "view", "0_view"]
    channel = F.regexp_extract("branch", "^([0-9]+)/", 1)
    feature = F.when(channel != "", F.concat_ws("_", channel, "metric")).otherwise(F.col("metric"))
    rows = t.eav.filter("object = 'cell'").select("well", "label", feature.alias("feature"), "value")
    wide = rows.groupBy("well", "label").pivot("feature", names).agg(F.avg("value"))
    return rounded(wide.filter(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull()), names)


@query("rsh_06_unnest_values", """
  SELECT user_id, metric, count(*) AS n, round(sum(v), 4) AS total FROM (
   SELECT user_id, event_type AS metric, unnest(list(value)) AS v FROM events GROUP BY user_id, event_type, event_id) GROUP BY ALL""")
def _(t):
    nested = t.events.select("user_id", F.col("event_type").alias("metric"), F.array("value").alias("values"))
    name, is_list = rs.value_column(nested.schema)
    rows = rs.explode_values(nested, name) if is_list else nested
    return rows.groupBy("user_id", "metric").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


@query("rsh_07_explode_targets", """
  SELECT DISTINCT p_partkey, trim(t) AS target FROM (SELECT p_partkey, unnest(string_split(p_name || '|' || p_type || '|', '|')) AS t FROM part)
  WHERE trim(t) <> ''""")
def _(t):
    lists = t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_type", F.lit("")).alias("targets"))
    return rs.explode_targets(lists, "targets")


@query("rsh_08_diagonal_concat", """
  SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL
  SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def _(t):
    return rs.concat_diagonal(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
                              t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


@query("rsh_09_flatten_group_stats", """WITH {runs}
  SELECT config, round(avg(pa) FILTER (WHERE codec = 'codec0'), 6) AS "PA_codec0_mean", max(n) FILTER (WHERE codec = 'codec0') AS "PA_codec0_n",
   round(avg(pa) FILTER (WHERE codec = 'codec1'), 6) AS "PA_codec1_mean", max(n) FILTER (WHERE codec = 'codec1') AS "PA_codec1_n" FROM runs GROUP BY config""")
def _(t):
    per = t.runs.groupBy("config", "codec").agg(r6(F.avg("pa")).alias("mean"), F.max("n").alias("n"))
    nested = per.groupBy("config").agg(F.map_from_entries(F.collect_list(F.struct("codec", F.struct("mean", "n")))).alias("g"))
    return rs.flatten_groups(nested, ["config"], "g", "PA", ["codec0", "codec1"], ["mean", "n"])


@query("rsh_11_rank_pivot", """WITH {runs}, b AS (SELECT family, codec, max(pa) AS s FROM runs GROUP BY ALL),
   r AS (SELECT family, codec, CAST(rank() OVER (PARTITION BY codec ORDER BY s DESC) AS DOUBLE) AS rk FROM b)
  SELECT family, max(rk) FILTER (WHERE codec = 'codec0') AS codec0, max(rk) FILTER (WHERE codec = 'codec1') AS codec1,
   max(rk) FILTER (WHERE codec = 'codec2') AS codec2, max(rk) FILTER (WHERE codec = 'codec3') AS codec3 FROM r GROUP BY family""")
def _(t):
    from phenospark.operators.results import rank_within

    best = t.runs.groupBy("family", "codec").agg(F.max("pa").alias("s"))
    return (rank_within(best, ["codec"], "s").groupBy("family")
            .pivot("codec", ["codec0", "codec1", "codec2", "codec3"]).agg(F.max("rank")))
