"""Window functions, sorts, set operations and sampling."""

from pyspark.sql import Window as W, functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import relational as rel


@query("win_01_first_sites_per_well", """WITH {site_index}
  SELECT source, batch, plate, well, site FROM (SELECT *, row_number() OVER (PARTITION BY source, batch, plate, well ORDER BY site) AS rn
  FROM site_index) WHERE rn <= 4""")
def _(t):
    keys = ["source", "batch", "plate", "well"]
    return rel.top_n_per_group(t.site_index.select(*keys, "site"), keys, [F.col("site")], 4)


@query("win_02_distinct_over", """WITH {annotations}
  SELECT a.compound, a.target, a.mode, n_modes FROM annotations a JOIN
  (SELECT target, count(DISTINCT mode) AS n_modes FROM annotations GROUP BY target) USING (target)""")
def _(t):
    per = t.annotations.groupBy("target").agg(F.countDistinct("mode").alias("n_modes"))
    return t.annotations.select("compound", "target", "mode").join(per, "target")


@query("win_03_is_duplicated", """
  SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand) > 1 AS dup FROM part""")
def _(t):
    per = t.part.groupBy("p_name", "p_brand").agg((F.count("*") > 1).alias("dup"))
    return t.part.join(per, ["p_name", "p_brand"]).select("p_partkey", "dup")


@query("win_04_sum_flags_over", """WITH {annotations}
  SELECT compound, target, CAST(sum(CASE WHEN support >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS BIGINT) AS n_strong FROM annotations""")
def _(t):
    per = t.annotations.groupBy("target").agg(F.count_if(F.col("support") >= 5).alias("n_strong"))
    return t.annotations.select("compound", "target").join(per, "target")


@query("win_05_top_n_per_group", """
  SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5""")
def _(t):
    cust = t.customer.select("c_nationkey", "c_custkey", "c_acctbal")
    return rel.top_n_per_group(cust, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)


@query("win_06_best_row", """WITH {runs}
  SELECT family, codec, config, pa FROM (SELECT *, row_number() OVER (PARTITION BY family, codec ORDER BY pa DESC, config DESC) AS rn FROM runs) WHERE rn = 1""")
def _(t):
    from phenospark.operators.results import best_row

    return best_row(t.runs, ["family", "codec"], "pa", ["config"]).select("family", "codec", "config", "pa")


@query("win_07_ordinal_ranks", """WITH {profiles}
  SELECT row_id, row_number() OVER (ORDER BY f1, row_id) AS r1, row_number() OVER (ORDER BY f0, row_id) AS r0 FROM profiles""")
def _(t):
    from phenospark.operators.frame import ProfileFrame
    from phenospark.operators.normalize import ordinal_ranks

    ranks = ordinal_ranks(ProfileFrame.from_wide(t.profiles.select("row_id", "f0", "f1"), ["f0", "f1"]))
    return ranks.groupBy("row_id").agg(F.max(F.when(F.col("idx") == 0, F.col("rank"))).alias("r0"),
                                       F.max(F.when(F.col("idx") == 1, F.col("rank"))).alias("r1"))


@query("win_08_average_ranks", """WITH {runs}
  SELECT family, codec, config, rank() OVER (PARTITION BY family ORDER BY n) + (count(*) OVER (PARTITION BY family, n) - 1) / 2.0::DOUBLE AS rk FROM runs""")
def _(t):
    from phenospark.operators.ordered import mean_rank

    return mean_rank(t.runs.select("family", "codec", "config", "n"), ["family"], "n", "rk").drop("n")


@query("win_09_cumulative_distribution", """
  WITH c AS (SELECT l_quantity AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
  SELECT v, round(sum(a) OVER (ORDER BY v) / (sum(a) OVER ()), 9) AS fa, round(sum(b) OVER (ORDER BY v) / (sum(b) OVER ()), 9) AS fb FROM c""")
def _(t):
    from phenospark.operators.stats import two_sample_cdf

    rows = t.lineitem.filter(F.col("l_returnflag").isin("A", "R"))
    flags = rows.select(F.lit("q").alias("feature"), F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "A").alias("is_a"))
    # Values seen only with other flags are part of the axis as well.
    axis = t.lineitem.filter(~F.col("l_returnflag").isin("A", "R")).select(
        F.lit("q").alias("feature"), F.col("l_quantity").alias("v"), F.lit(None).cast("boolean").alias("is_a"))
    out = two_sample_cdf(flags.unionByName(axis), ["feature"], "v", "is_a")
    return out.select("v", r6("fa", 9).alias("fa"), r6("fb", 9).alias("fb"))


@query("win_11_rank_per_codec", """WITH {runs}, b AS (SELECT family, codec, max(n) AS s FROM runs GROUP BY ALL)
  SELECT family, codec, rank() OVER (PARTITION BY codec ORDER BY s DESC) + (count(*) OVER (PARTITION BY codec, s) - 1) / 2.0::DOUBLE AS rank FROM b""")
def _(t):
    from phenospark.operators.results import rank_within

    best = t.runs.groupBy("family", "codec").agg(F.max("n").alias("s"))
    return rank_within(best, ["codec"], "s").drop("s")


# ---- sorts and limits ------------------------------------------------------------------------

@query("srt_01_full_sort", """WITH {site_index} SELECT * FROM site_index ORDER BY source, batch, plate, well, site""")
def _(t):
    return t.site_index.orderBy("source", "batch", "plate", "well", "site")


@query("srt_02_nulls_last", """WITH {runs} SELECT family, CASE WHEN n > 3 THEN pa END AS pa, config, codec FROM runs ORDER BY family, pa DESC NULLS LAST""")
def _(t):
    return (t.runs.select("family", F.when(F.col("n") > 3, F.col("pa")).alias("pa"), "config", "codec")
            .orderBy(F.col("family").asc(), F.col("pa").desc_nulls_last()))


@query("srt_04_first_two_wells", """WITH {profiles}
  SELECT plate, compound, well FROM (SELECT plate, well AS compound, compound AS well, row_number() OVER (PARTITION BY plate, well ORDER BY compound) AS rn FROM profiles) WHERE rn <= 2""")
def _(t):
    rows = t.profiles.select("plate", F.col("well").alias("compound"), F.col("compound").alias("well"))
    return rel.top_n_per_group(rows, ["plate", "compound"], [F.col("well")], 2)


@query("srt_05_ordered_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey").orderBy("o_custkey", "o_orderkey").limit(100)


@query("srt_06_custom_order", """WITH {runs}
  SELECT codec, config, family, CASE codec WHEN 'codec3' THEN 0 WHEN 'codec1' THEN 1 ELSE 2 END AS pos FROM runs ORDER BY pos, codec, config""")
def _(t):
    return (t.runs.select("codec", "config", "family", rel.order_by_list("codec", ["codec3", "codec1"]).alias("pos"))
            .orderBy("pos", "codec", "config"))


@query("srt_07_best_median_worst", """
  WITH s AS (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id),
   r AS (SELECT user_id, round(m, 6) AS m, row_number() OVER (ORDER BY m, user_id) AS rn, count(*) OVER () AS n FROM s)
  SELECT CASE WHEN rn = 1 THEN 'worst' WHEN rn = n THEN 'best' ELSE 'median' END AS pick, user_id, m FROM r
  WHERE rn = 1 OR rn = n OR rn = n // 2 + 1""")
def _(t):
    from phenospark.operators.masks import sample_picks

    scores = t.events.groupBy("user_id").agg(F.avg("value").alias("m"))
    return sample_picks(scores, "user_id", "m").select("pick", "user_id", r6("m").alias("m"))


@query("srt_08_feature_ranking", """
  (SELECT 'top' AS side, l_suppkey, round(avg(l_tax), 9) AS m FROM lineitem GROUP BY ALL ORDER BY m DESC, l_suppkey LIMIT 10) UNION ALL
  (SELECT 'bottom', l_suppkey, round(avg(l_tax), 9) AS m FROM lineitem GROUP BY ALL ORDER BY m, l_suppkey LIMIT 10)""")
def _(t):
    means = t.lineitem.groupBy("l_suppkey").agg(r6(F.avg("l_tax"), 9).alias("m"))
    top = means.orderBy(F.col("m").desc(), "l_suppkey").limit(10).withColumn("side", F.lit("top"))
    low = means.orderBy("m", "l_suppkey").limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).select("side", "l_suppkey", "m")


# ---- sets ------------------------------------------------------------------------------------

@query("set_01_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def _(t):
    return t.supplier.select(F.col("s_nationkey").alias("k")).unionByName(t.customer.select(F.col("c_nationkey").alias("k")))


@query("set_02_symmetrize", """
  WITH e AS (SELECT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem) SELECT a, b FROM e UNION SELECT b, a FROM e""")
def _(t):
    return rel.symmetrize(t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")), "a", "b")


@query("set_03_key_coverage", """
  WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
  SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both,
   (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b""")
def _(t):
    return rel.key_coverage(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")),
                            t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("set_04_missing_extra", """
  WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0)
  SELECT k, 'missing' AS status FROM b ANTI JOIN a USING (k) UNION ALL SELECT k, 'extra' FROM a ANTI JOIN b USING (k)""")
def _(t):
    return rel.missing_and_extra(t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")),
                                 t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("set_05_dedupe_subset", """
  SELECT l_partkey, r.l_orderkey AS l_orderkey, r.l_suppkey AS l_suppkey FROM (SELECT l_partkey, min({'l_orderkey': l_orderkey, 'l_suppkey': l_suppkey}) AS r FROM lineitem GROUP BY 1)""")
def _(t):
    return rel.first_per_key(t.lineitem.select("l_partkey", "l_orderkey", "l_suppkey"), ["l_partkey"])


@query("set_06_canonical_pairs", """
  SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi FROM lineitem WHERE l_suppkey <> l_partkey % 100""")
def _(t):
    return rel.canonical_pairs(t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")), "a", "b")


@query("set_07_common_features", """
  SELECT p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 GROUP BY p_name HAVING count(DISTINCT l_returnflag) = 3""")
def _(t):
    from phenospark.operators.stats import common_features

    rows = t.lineitem.filter("l_quantity > 49").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return common_features(rows, "p_name", "l_returnflag", 3)


@query("set_08_membership_patterns", """
  WITH f AS (SELECT c_custkey, 1 AS s_all, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS s_funded,
    CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 1 ELSE 0 END AS s_ordered FROM customer)
  SELECT s_all, s_funded, s_ordered, count(*) AS n_ids FROM f GROUP BY ALL""")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    step = lambda df, s: df.select("c_custkey", F.lit(s).alias("step"))
    ordered = c.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    steps = step(c, "s_all").unionByName(step(c.filter("c_acctbal > 0"), "s_funded")).unionByName(step(ordered, "s_ordered"))
    return rel.membership_patterns(steps, ["s_all", "s_funded", "s_ordered"], "step", "c_custkey")


@query("set_09_overlap_statistics", """WITH {annotations}
  SELECT count(DISTINCT compound) AS n_annotated, count(DISTINCT target) AS n_targets, count(DISTINCT CASE WHEN compound IN
   (SELECT p_partkey FROM part WHERE p_size > 20) THEN compound END) AS n_released, count(DISTINCT CASE WHEN compound IN
   (SELECT p_partkey FROM part WHERE p_size > 20) THEN target END) AS n_released_targets FROM annotations""")
def _(t):
    released = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("compound"))
    kept = t.annotations.join(released, "compound", "left_semi")
    return t.annotations.agg(F.countDistinct("compound").alias("n_annotated"), F.countDistinct("target").alias("n_targets")).join(
        F.broadcast(kept.agg(F.countDistinct("compound").alias("n_released"), F.countDistinct("target").alias("n_released_targets"))))


# ---- sampling (in the order of MD5 over seed and key, which SQL can repeat) ----------------

@query("smp_01_fraction_per_plate", """WITH {profiles}, o AS (SELECT plate, row_id, row_number() OVER (PARTITION BY plate ORDER BY md5('42|' || row_id)) AS rn,
   greatest(1, floor(count(*) OVER (PARTITION BY plate) * 0.1::DOUBLE)) AS k FROM profiles) SELECT plate, row_id FROM o WHERE rn <= k""")
def _(t):
    return rel.sample_fraction_per_group(t.profiles.select("plate", "row_id"), ["plate"], ["row_id"], 0.1, seed=42)


@query("smp_01_fraction_counts", """WITH {profiles}
  SELECT plate, CAST(greatest(1, floor(count(*) * 0.1::DOUBLE)) AS BIGINT) AS n FROM profiles GROUP BY plate""")
def _(t):
    out = rel.sample_fraction_per_group(t.profiles.select("plate", "row_id"), ["plate"], ["row_id"], 0.1, seed=42)
    return out.groupBy("plate").agg(F.count("*").alias("n"))


@query("smp_02_nested_subsample", """WITH {profiles}, p AS (SELECT compound FROM (SELECT DISTINCT compound FROM profiles WHERE NOT negcon) ORDER BY md5('1|' || compound) LIMIT 20),
   kept AS (SELECT * FROM profiles WHERE NOT negcon AND compound IN (FROM p))
  SELECT row_id, plate, compound, negcon FROM kept UNION ALL SELECT row_id, plate, compound, negcon FROM profiles WHERE negcon AND plate IN (SELECT plate FROM kept)""")
def _(t):
    return rel.nested_subsample(t.profiles.select("row_id", "plate", "compound", "negcon"), "compound", F.col("negcon"), "plate", 20, seed=1)


@query("smp_03_random_bucket", "SELECT event_id, CAST(('0x' || substr(md5('3|' || event_id), 1, 15))::BIGINT % 10 + 1 AS INTEGER) AS bucket FROM events")
def _(t):
    return t.events.select("event_id", rel.random_bucket(["event_id"], 10, seed=3).alias("bucket"))


@query("smp_04_random_k", "SELECT c_custkey FROM customer ORDER BY md5('5|' || c_custkey) LIMIT 50")
def _(t):
    return rel.random_k(t.customer.select("c_custkey"), ["c_custkey"], 50, seed=5)
