"""Reading and writing profile tables, measurement files and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from phenospark.operators.relational import META_PREFIX, enrich

SUFFIX_FORMATS = {".parquet": "parquet", ".csv": "csv", ".csv.gz": "csv", ".tsv": "tsv", ".txt": "tsv"}


def infer_format(path: str) -> str:
    for suffix, fmt in sorted(SUFFIX_FORMATS.items(), key=lambda kv: -len(kv[0])):
        if path.lower().rstrip("/").endswith(suffix):
            return fmt
    return "parquet"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def load_profiles(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV (also gzipped) or TSV by suffix; a missing path is an error.

    Give a schema for CSV at scale: without one Spark reads the files twice to infer types.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fmt = fmt or infer_format(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true").option("sep", "\t" if fmt == "tsv" else ",")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def save_profiles(df: DataFrame, path: str, fmt: str = "parquet", compression: str | None = None,
                  if_exists: str = "overwrite") -> None:
    """Parquet (zstd by default) or CSV. The job commit makes the output visible as a whole.

    ``if_exists``: 'overwrite', 'refuse' (error when the path exists) or 'skip'.
    """
    mode = {"overwrite": "overwrite", "refuse": "errorifexists", "skip": "ignore"}[if_exists]
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.option("compression", compression or "zstd").parquet(path)
    elif fmt == "csv":
        writer.option("header", "true").option("compression", compression or "none").csv(path)
    elif fmt == "json":
        writer.option("compression", compression or "none").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def load_metadata(spark: SparkSession, paths: Sequence[str], how: str = "left") -> DataFrame:
    """Files joined one after the other on the columns they share, compared as strings; names get the prefix."""
    out = None
    for path in paths:
        df = load_profiles(spark, path)
        out = df if out is None else enrich(out, df, [c for c in out.columns if c in df.columns], how)
    renamed = out.withColumnsRenamed({"pert_type": "control_type", META_PREFIX + "pert_type": META_PREFIX + "control_type"})
    return renamed.withColumnsRenamed({c: META_PREFIX + c for c in renamed.columns if not c.startswith(META_PREFIX)})


def scan_measurements(spark: SparkSession, path: str) -> DataFrame:
    """All measurement files under a folder with the base name of their file."""
    base = F.regexp_replace("_metadata.file_name", r"\.[a-z.]+$", "")
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select("*", base.alias("file"))


def site_parts(key: Column, sep: str = "__") -> list[Column]:
    """source, batch, plate, well, site of a composite key."""
    parts = F.split(key, sep)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("source", "batch", "plate", "well", "site"))]


def well_id(key: Column, sep: str = "__") -> Column:
    return F.array_join(F.slice(F.split(key, sep), 1, 4), sep)


def layout_columns(path: Column, model: str | None = None, dataset: str | None = None) -> list[Column]:
    """model, dataset and compression from ``.../MODEL/DATASET/CODEC/profiles/...``.

    The first two may come in either order; a known model or dataset name settles it.
    """
    outer, inner, codec = (F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+)/profiles(?:/|$)", i) for i in (1, 2, 3))
    swapped = F.lit(False)
    if model is not None:
        swapped = inner == model
    elif dataset is not None:
        swapped = outer == dataset
    return [F.when(swapped, inner).otherwise(outer).alias("model"), F.when(swapped, outer).otherwise(inner).alias("dataset"),
            codec.alias("compression")]


def discover_profiles(files: DataFrame, path: str = "path", model: str | None = None, dataset: str | None = None,
                      compression: str | None = None) -> DataFrame:
    """Distinct profile folders found in a file listing, without cache folders, under the given filters."""
    folder = F.regexp_extract(path, r"^(.*/profiles)(?:/|$)", 1)
    rows = files.select(F.col(path), folder.alias("profiles_path")).filter("profiles_path <> ''")
    rows = rows.filter(~F.lower("profiles_path").contains("cache"))
    out = rows.select(*layout_columns(F.col(path), model, dataset), "profiles_path").distinct().filter("model <> ''")
    for name, wanted in (("model", model), ("dataset", dataset), ("compression", compression)):
        if wanted is not None:
            out = out.filter(F.col(name) == wanted)
    return out


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(path).select("path", "length"))


def sample_layout(df: DataFrame) -> tuple[str, str | None, bool]:
    """(layout, value column, whether it is a list) of measurement rows."""
    from phenospark.operators.reshape import CELL_OBJECTS, detect_layout, value_column

    if "metric" not in df.columns:
        return "wide", None, False
    objects = [o for o in CELL_OBJECTS if not df.filter(F.col("object") == o).isEmpty()] if "object" in df.columns else []
    col, is_list = value_column(df.schema)
    return detect_layout(df.columns, objects), col, is_list


def scan_csv_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files given one by one, united by column name; an absent column is NULL.

    Files with the same header are read in one scan, so the plan grows with the distinct headers.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        header = tuple(spark.read.option("header", "true").csv(p).columns)
        by_header.setdefault(header, []).append(p)
    out = None
    for header, group in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = spark.read.option("header", "true").schema(schema).csv(group)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# Column names a splits file may use.
KEY_CANDIDATES = ("inchikey", "InChIKey", "Metadata_InChIKey", "compound_id")
SPLIT_CANDIDATES = ("split", "Split", "fold", "partition")


def load_splits(spark: SparkSession, path: str, key: str | None = None, split: str | None = None) -> DataFrame:
    """(key, split) of a splits file with its columns found by name."""
    df = load_profiles(spark, path)

    def find(given, candidates):
        options = [given] if given else list(candidates)
        hit = [c for c in options if c in df.columns]
        if not hit:
            raise ValueError(f"none of {options} in {df.columns}")
        return hit[0]

    return df.select(F.col(find(key, KEY_CANDIDATES)).alias("key"), F.col(find(split, SPLIT_CANDIDATES)).alias("split"))


def load_metrics(spark: SparkSession, path: str, schema: T.StructType | str, name: str = "metrics.json") -> DataFrame:
    """Metric records of all runs below a folder; model and config come from the two folders above the file."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("multiLine", "true")
          .schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_p")))
    return df.withColumns({"model": F.regexp_extract("_p", r"([^/]+)/[^/]+/[^/]+$", 1),
                           "config": F.regexp_extract("_p", r"([^/]+)/[^/]+$", 1)}).drop("_p")


def relation_results(nested: DataFrame, tasks: Sequence[str] = ("cc", "gg", "cg"), setting: str = "full") -> DataFrame:
    """Arrays of summary structs per task become long rows; tasks with a setting keep the wanted one."""
    out = None
    ids = [c for c in nested.columns if c not in tasks]
    for task in tasks:
        rows = nested.select(*ids, F.lit(task).alias("task"), F.inline_outer(F.col(task)))
        if "setting" in rows.columns:
            rows = rows.filter((F.col("setting") == setting) | F.col("setting").isNull())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def scan_named_csv(spark: SparkSession, path: str, pattern: str, names: Sequence[str], schema=None) -> DataFrame:
    """CSV files with labels taken from the path of the file by the pattern's groups."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    df = reader.csv(path).select("*", F.col("_metadata.file_path").alias("_f"))
    return df.withColumns({n: F.regexp_extract("_f", pattern, i + 1) for i, n in enumerate(names)}).drop("_f")


def scan_named_parquet(spark: SparkSession, path: str, pattern: str, names: Sequence[str]) -> DataFrame:
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_f"))
    return df.withColumns({n: F.regexp_extract("_f", pattern, i + 1) for i, n in enumerate(names)}).drop("_f")


def strip_uri(uri: str, prefix: str) -> Column:
    """Object key of a URI below a prefix."""
    return F.when(F.col(uri).startswith(prefix), F.substring(F.col(uri), F.lit(len(prefix) + 1), F.length(uri))).otherwise(F.col(uri))


def flatten_header(df: DataFrame, first: str, header_rows: Sequence[str]) -> DataFrame:
    """Tables written with a two-level header: drop the rows that repeat header words in the first column."""
    return df.filter(~F.col(first).isin(list(header_rows)) & F.col(first).isNotNull())
