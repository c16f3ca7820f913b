"""Sources and sinks: each query writes rows derived from the tables into the shared folder and reads them back."""

from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import reshape as rs
from phenospark.session import scratch_path
from phenospark.sources import io


@query("src_01_load_profiles", "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer") + ".csv.gz"
    io.save_profiles(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), path, "csv", "gzip")
    return io.load_profiles(t.spark, path, schema="c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double")


@query("src_02_save_profiles", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    path = scratch_path(t.spark, "supplier")
    io.save_profiles(t.supplier, path)
    return io.load_profiles(t.spark, path)


@query("src_03_load_metadata", """
  SELECT CAST(s_nationkey AS VARCHAR) AS "Metadata_nationkey", s_suppkey AS "Metadata_suppkey", n_name AS "Metadata_name",
    'trt' AS "Metadata_control_type" FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    a, b = scratch_path(t.spark, "wells"), scratch_path(t.spark, "plates")
    io.save_profiles(t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("suppkey")), a)
    io.save_profiles(t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"),
                                     F.lit("trt").alias("pert_type")), b)
    return io.load_metadata(t.spark, [a, b])


def plate_files(t, name):
    """Measurement rows stored as one folder per plate key."""
    path = scratch_path(t.spark, name)
    key = F.concat_ws("__", F.lit("source_1"), F.lit("B1"), (F.col("well") % 5).cast("string"))
    t.eav.withColumn("key", key).repartition("key").write.partitionBy("key").parquet(path)
    return path


@query("src_04_measurement_scan", """WITH {eav}
  SELECT 'source_1' AS source, 'B1' AS batch, CAST(well % 5 AS VARCHAR) AS plate, 'source_1__B1__' || (well % 5) || '__' || well AS well_id,
    count(*) AS n, round(sum(value), 4) AS total, true AS has_file FROM eav GROUP BY well""")
def _(t):
    df = io.scan_measurements(t.spark, plate_files(t, "plates"))
    path_key = F.regexp_extract(F.input_file_name(), "key=([^/]+)/", 1)
    keyed = df.withColumn("site_key", F.concat_ws("__", path_key, F.col("well").cast("string"), F.col("site").cast("string")))
    parts = keyed.select(*io.site_parts(F.col("site_key"))[:3], io.well_id(F.col("site_key")).alias("well_id"), "value", "file")
    return parts.groupBy("source", "batch", "plate", "well_id").agg(
        F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"), F.bool_and(F.col("file") != "").alias("has_file"))


@query("src_05_discover_profiles", """
  SELECT DISTINCT lower(c_mktsegment) AS model, 'data' || (c_nationkey % 3) AS dataset, 'codec' || (c_custkey % 2) AS compression,
    'base/' || 'data' || (c_nationkey % 3) || '/' || lower(c_mktsegment) || '/codec' || (c_custkey % 2) || '/profiles' AS profiles_path
  FROM customer WHERE lower(c_mktsegment) = 'building'""")
def _(t):
    listing = t.customer.select(F.concat_ws(
        "/", F.lit("base"), F.concat(F.lit("data"), (F.col("c_nationkey") % 3).cast("string")), F.lower("c_mktsegment"),
        F.concat(F.lit("codec"), (F.col("c_custkey") % 2).cast("string")), F.lit("profiles"),
        F.concat(F.col("c_name"), F.lit(".parquet"))).alias("path"))
    return io.discover_profiles(listing, model="building")


@query("src_06_detect_layout", """WITH {eav}
  SELECT 'cp_long' AS layout, 'values' AS value_column, true AS is_list, count(*) AS n_rows FROM eav""")
def _(t):
    nested = t.eav.withColumn("values", F.array("value")).drop("value")
    layout, col, is_list = io.sample_layout(nested)
    return rs.explode_values(nested, col).agg(F.count("*").alias("n_rows")).select(
        F.lit(layout).alias("layout"), F.lit(col).alias("value_column"), F.lit(is_list).alias("is_list"), "n_rows")


@query("src_07_csv_list_by_name", """
  SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, NULL AS region FROM nation UNION ALL
  SELECT CAST(r_regionkey AS VARCHAR), NULL, r_name FROM region""")
def _(t):
    a, b = scratch_path(t.spark, "list-a"), scratch_path(t.spark, "list-b")
    io.save_profiles(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), a, "csv")
    io.save_profiles(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region")), b, "csv")
    return io.scan_csv_list(t.spark, [a, b])


@query("src_08_load_splits", "SELECT p_partkey AS key, CASE WHEN p_size % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM part")
def _(t):
    path = scratch_path(t.spark, "splits") + ".csv"
    fold = F.when(F.col("p_size") % 10 < 7, "train").otherwise("test")
    io.save_profiles(t.part.select(F.col("p_partkey").alias("compound_id"), fold.alias("fold")), path, "csv")
    return io.load_splits(t.spark, path).select(F.col("key").cast("bigint").alias("key"), "split")


METRIC_SCHEMA = "pa double, pc double, n bigint, groups map<string, struct<mean: double, n: bigint>>"


def run_files(t):
    """One metrics.json per (family, config) below <root>/<family>/<config>/."""
    path = scratch_path(t.spark, "sweep")
    runs = t.runs.groupBy("family", "config").agg(
        r6(F.avg("pa")).alias("pa"), r6(F.avg("pc")).alias("pc"), F.sum("n").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("codec", F.struct(r6("pa").alias("mean"), F.col("n").alias("n")))))).alias("groups"))
    runs.withColumns({"model": F.col("family"), "cfg": F.col("config")}).drop("family", "config").write.partitionBy("model", "cfg").json(path)
    return path


@query("src_09_metrics_json", """WITH {runs}
  SELECT family AS model, config, round(avg(pa), 6) AS pa, CAST(sum(n) AS BIGINT) AS n FROM runs GROUP BY family, config""")
def _(t):
    df = io.load_metrics(t.spark, run_files(t), METRIC_SCHEMA, name="*.json")
    tidy = lambda c: F.regexp_replace(c, "^[a-z]+=", "")
    return df.select(tidy("model").alias("model"), tidy("config").alias("config"), "pa", "n")


@query("src_10_relation_results", """WITH {runs}
  SELECT family, config, task, codec, round(pa, 6) AS recall_5 FROM runs, (VALUES ('cc'), ('cg')) v(task) WHERE task = 'cc' OR codec <> 'codec0'""")
def _(t):
    path = scratch_path(t.spark, "relation")
    entry = lambda *more: F.sort_array(F.collect_list(F.struct("codec", r6("pa").alias("recall_5"), *more)))
    setting = F.when(F.col("codec") == "codec0", "filtered").otherwise("full").alias("setting")
    (t.runs.groupBy("family", "config").agg(entry().alias("cc"), entry(setting).alias("cg")).write.json(path))
    nested = t.spark.read.schema("family string, config string, cc array<struct<codec: string, recall_5: double>>, "
                                 "cg array<struct<codec: string, recall_5: double, setting: string>>").json(path)
    return io.relation_results(nested, ("cc", "cg")).select("family", "config", "task", "codec", "recall_5")


@query("src_11_named_csv", """
  SELECT lower(c_mktsegment) AS object, c_nationkey % 2 AS codec, count(*) AS n FROM customer GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "detail")
    named = t.customer.select("c_custkey", F.concat(F.lit("segment_"), F.lower("c_mktsegment"), F.lit("_"),
                                                    (F.col("c_nationkey") % 2).cast("string")).alias("name"))
    named.write.partitionBy("name").option("header", "true").csv(path)
    df = io.scan_named_csv(t.spark, path, "segment_([^/]*)_([0-9]+)/[^/]*$", ("object", "codec"), "c_custkey bigint")
    return df.groupBy("object", F.col("codec").cast("int").alias("codec")).agg(F.count("*").alias("n"))


@query("src_12_instance_mappings", """WITH {masks}
  SELECT 'method' || (site % 3) AS method, count(*) AS n FROM (SELECT DISTINCT site, gt_id, pred_id FROM masks) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "mappings")
    rows = t.masks.select("site", "gt_id", "pred_id").distinct()
    rows.withColumn("method", F.concat(F.lit("method"), (F.col("site") % 3).cast("string"))).write.partitionBy("method").parquet(path)
    return io.scan_named_parquet(t.spark, path, "method=([^/]*)/[^/]*$", ("method",)).groupBy("method").agg(F.count("*").alias("n"))


@query("src_13_atomic_sink", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "atomic")
    rows = t.orders.select("o_orderkey", "o_totalprice")
    io.save_profiles(rows.filter("o_orderkey < 0"), path)
    io.save_profiles(rows, path, if_exists="overwrite")
    return io.load_profiles(t.spark, path)


@query("src_14_refuse_overwrite", "SELECT true AS refused, count(*) AS n_rows FROM nation")
def _(t):
    from pyspark.errors import AnalysisException

    path = scratch_path(t.spark, "refuse")
    io.save_profiles(t.nation, path, if_exists="refuse")
    try:
        io.save_profiles(t.nation.unionByName(t.nation), path, if_exists="refuse")
        refused = False
    except AnalysisException:
        refused = True
    io.save_profiles(t.nation.unionByName(t.nation), path, if_exists="skip")
    return io.load_profiles(t.spark, path).agg(F.count("*").alias("n_rows")).withColumn("refused", F.lit(refused))


@query("src_15_result_sinks", """WITH {runs} SELECT family, codec, round(max(pa), 6) AS best FROM runs GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "result")
    io.save_profiles(t.runs.groupBy("family", "codec").agg(r6(F.max("pa")).alias("best")), path, "json")
    return t.spark.read.schema("family string, codec string, best double").json(path)


@query("src_16_resume", """WITH {runs} SELECT family, codec, config FROM runs WHERE NOT (n > 3 AND codec = 'codec1')""")
def _(t):
    from phenospark.operators.results import not_done

    todo = t.runs.select("family", "codec", "config")
    return not_done(todo, t.runs.filter("n > 3 AND codec = 'codec1'"), ["family", "codec", "config"])


@query("src_17_uri_manifest", """
  SELECT o_orderkey, 'source_1' AS source, CAST(o_custkey AS VARCHAR) AS plate, 'images/' || o_custkey || '/' || o_orderkey || '.tif' AS object_key FROM orders""")
def _(t):
    uris = t.orders.select("o_orderkey", F.format_string("s3://bucket/source_1/images/%d/%d.tif", "o_custkey", "o_orderkey").alias("uri"))
    return uris.select("o_orderkey", F.lit("source_1").alias("source"), F.regexp_extract("uri", "images/([^/]+)/", 1).alias("plate"),
                       io.strip_uri("uri", "s3://bucket/source_1/").alias("object_key"))


@query("rsh_10_two_level_header", "SELECT c_mktsegment AS k, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "header")
    body = t.customer.groupBy(F.col("c_mktsegment").alias("k")).agg(r6(F.avg("c_acctbal"), 4).cast("string").alias("mean"))
    header = t.region.limit(1).select(F.lit("codec").alias("k"), F.lit("mean").alias("mean"))
    io.save_profiles(header.unionByName(body), path, "csv")
    df = io.flatten_header(t.spark.read.option("header", "true").csv(path), "k", ["codec"])
    return df.select("k", F.col("mean").cast("double").alias("mean"))
