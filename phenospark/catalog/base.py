"""Registry of queries with their SQL oracles, and the fixtures both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the given Parquet tables and the profile-shaped views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def profiles(self) -> DataFrame:
        """One row per (plate, compound) with four features."""
        return (
            self.lineitem.groupBy("l_suppkey", "l_partkey")
            .agg(
                F.round(F.avg("l_quantity"), 6).alias("f0"),
                F.round(F.avg("l_extendedprice"), 4).alias("f1"),
                F.round(F.avg("l_discount"), 6).alias("f2"),
                F.round(F.avg("l_tax"), 6).alias("f3"),
            )
            .select(
                F.concat_ws("_", "l_suppkey", "l_partkey").alias("row_id"),
                F.col("l_suppkey").alias("plate"),
                F.col("l_partkey").alias("compound"),
                (F.col("l_partkey") % 96).alias("well"),
                F.when(F.col("l_suppkey") % 2 == 0, "g0").otherwise("g1").alias("grp"),
                (F.col("l_partkey") % 16 == 0).alias("negcon"),
                "f0", "f1", "f2", "f3",
            )
        )

    @property
    def bad_profiles(self) -> DataFrame:
        """The same rows with NaN, NULL and Inf injected by rule."""
        p = self.profiles
        return p.withColumns({
            "f1": F.when(F.col("compound") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("f1")),
            "f2": F.when(F.col("compound") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("f2")),
            "f3": F.when(F.col("compound") % 13 != 0, F.col("f3")),
        })

    @property
    def eav(self) -> DataFrame:
        """Long-form measurements: one row per (site file, object, metric) reading."""
        return self.events.select(
            F.col("user_id").alias("well"),
            (F.col("event_id") % 4).alias("site"),
            (F.col("event_id") % 50).alias("label"),
            F.when(F.col("event_id") % 3 == 0, "nuclei").otherwise("cell").alias("object"),
            F.when(F.col("event_id") % 2 == 0, "shape").otherwise("0/max").alias("branch"),
            F.col("event_type").alias("metric"),
            "value",
            (F.col("event_id") % 2).cast("int").alias("tp"),
        )

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("row_id"),
            (F.col("vec_id") % 8).cast("string").alias("batch"),
            (F.col("vec_id") % 5 == 0).alias("negcon"),
            F.col("label").alias("compound"),
            F.col("embedding").cast("array<double>").alias("features"),
        )

    @property
    def runs(self) -> DataFrame:
        """Result rows: one score per (family, codec, config)."""
        return (
            self.customer.groupBy(
                F.col("c_mktsegment").alias("family"),
                F.concat(F.lit("codec"), (F.col("c_nationkey") % 4).cast("string")).alias("codec"),
                F.concat(F.lit("cfg"), (F.col("c_custkey") % 25).cast("string")).alias("config"),
            )
            .agg(
                F.round(F.avg("c_acctbal"), 9).alias("pa"),
                F.round(F.avg(F.abs("c_acctbal")) / 97, 9).alias("pc"),
                F.count("*").alias("n"),
            )
            .withColumn("modality", F.when(F.col("codec").isin("codec0", "codec1"), F.lit("orf")))
        )

    @property
    def annotations(self) -> DataFrame:
        """Compound-target annotations with support counts."""
        return (
            self.lineitem.groupBy("l_partkey", "l_linenumber").agg(F.count("*").alias("support"))
            .select(
                F.col("l_partkey").alias("compound"),
                F.concat(F.lit("T"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 500).cast("string")).alias("target"),
                F.when(F.col("l_linenumber") == 7, "family").otherwise("gene").alias("target_type"),
                F.when((F.col("l_partkey") + F.col("l_linenumber")) % 5 == 0, "unspecified")
                .when((F.col("l_partkey") + F.col("l_linenumber")) % 5 < 3, "activation")
                .otherwise("inhibition").alias("mode"),
                "support",
            )
        )

    @property
    def edges(self) -> DataFrame:
        """Compound-gene relations: p_name is the target, p_type the relation, p_size the class."""
        return self.part.select(
            F.col("p_partkey").alias("compound"),
            F.col("p_name").alias("target"),
            F.col("p_type").alias("rel_type"),
            F.col("p_brand").alias("brand"),
        )

    @property
    def masks(self) -> DataFrame:
        """Pixel-label rows of two label images per site."""
        return self.events.select(
            F.col("user_id").alias("site"),
            F.col("event_id").alias("pixel"),
            (F.col("event_id") % 7).alias("gt_id"),
            F.when(F.col("event_id") % 10 < 8, F.col("event_id") % 7)
            .otherwise((F.col("event_id") + 3) % 7).alias("pred_id"),
        )

    @property
    def site_index(self) -> DataFrame:
        """Image index rows (source, batch, plate, well, site) with two channel URLs."""
        return self.orders.select(
            F.concat(F.lit("source_"), F.substring("o_orderpriority", 1, 1)).alias("source"),
            F.concat(F.lit("B"), F.year("o_orderdate").cast("string")).alias("batch"),
            F.concat(F.lit("P"), (F.col("o_custkey") % 20).cast("string")).alias("plate"),
            F.concat(F.lit("W"), (F.col("o_custkey") % 96).cast("string")).alias("well"),
            F.col("o_orderkey").alias("site"),
            F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit("/dna")).alias("URL_DNA"),
            F.when(F.col("o_orderstatus") != "P",
                   F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit("/rna"))).alias("URL_RNA"),
        )


# The same fixtures for the SQL oracle, by name.
CTES = {
    "profiles": """profiles AS (
        SELECT l_suppkey || '_' || l_partkey AS row_id, l_suppkey AS plate, l_partkey AS compound,
               l_partkey % 96 AS well, CASE WHEN l_suppkey % 2 = 0 THEN 'g0' ELSE 'g1' END AS grp,
               l_partkey % 16 = 0 AS negcon, round(avg(l_quantity), 6) AS f0,
               round(avg(l_extendedprice), 4) AS f1, round(avg(l_discount), 6) AS f2, round(avg(l_tax), 6) AS f3
        FROM lineitem GROUP BY l_suppkey, l_partkey)""",
    "bad_profiles": """bad_profiles AS (
        SELECT row_id, plate, compound, well, grp, negcon, f0,
               CASE WHEN compound % 97 = 0 THEN 'inf'::DOUBLE ELSE f1 END AS f1,
               CASE WHEN compound % 11 = 0 THEN 'nan'::DOUBLE ELSE f2 END AS f2,
               CASE WHEN compound % 13 <> 0 THEN f3 END AS f3
        FROM profiles)""",
    "plong": """plong AS (
        SELECT row_id, plate, compound, well, grp, negcon, 'f0' AS feature, f0 AS v FROM profiles
        UNION ALL SELECT row_id, plate, compound, well, grp, negcon, 'f1', f1 FROM profiles
        UNION ALL SELECT row_id, plate, compound, well, grp, negcon, 'f2', f2 FROM profiles
        UNION ALL SELECT row_id, plate, compound, well, grp, negcon, 'f3', f3 FROM profiles)""",
    "bad_long": """bad_long AS (
        SELECT row_id, plate, compound, 'f0' AS feature, f0 AS v FROM bad_profiles
        UNION ALL SELECT row_id, plate, compound, 'f1', f1 FROM bad_profiles
        UNION ALL SELECT row_id, plate, compound, 'f2', f2 FROM bad_profiles
        UNION ALL SELECT row_id, plate, compound, 'f3', f3 FROM bad_profiles)""",
    "eav": """eav AS (
        SELECT user_id AS well, event_id % 4 AS site, event_id % 50 AS label,
               CASE WHEN event_id % 3 = 0 THEN 'nuclei' ELSE 'cell' END AS object,
               CASE WHEN event_id % 2 = 0 THEN 'shape' ELSE '0/max' END AS branch,
               event_type AS metric, value, CAST(event_id % 2 AS INTEGER) AS tp FROM events)""",
    "runs": """runs AS (
        SELECT *, CASE WHEN codec IN ('codec0', 'codec1') THEN 'orf' END AS modality FROM (
        SELECT c_mktsegment AS family, 'codec' || (c_nationkey % 4) AS codec, 'cfg' || (c_custkey % 25) AS config,
               round(avg(c_acctbal), 9) AS pa, round(avg(abs(c_acctbal)) / 97, 9) AS pc, count(*) AS n
        FROM customer GROUP BY ALL))""",
    "annotations": """annotations AS (
        SELECT l_partkey AS compound, 'T' || ((l_partkey * 7 + l_linenumber) % 500) AS target,
               CASE WHEN l_linenumber = 7 THEN 'family' ELSE 'gene' END AS target_type,
               CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN 'unspecified'
                    WHEN (l_partkey + l_linenumber) % 5 < 3 THEN 'activation' ELSE 'inhibition' END AS mode,
               count(*) AS support
        FROM lineitem GROUP BY l_partkey, l_linenumber)""",
    "edges": """edges AS (
        SELECT p_partkey AS compound, p_name AS target, p_type AS rel_type, p_brand AS brand FROM part)""",
    "masks": """masks AS (
        SELECT user_id AS site, event_id AS pixel, event_id % 7 AS gt_id,
               CASE WHEN event_id % 10 < 8 THEN event_id % 7 ELSE (event_id + 3) % 7 END AS pred_id FROM events)""",
    "site_index": """site_index AS (
        SELECT 'source_' || substr(o_orderpriority, 1, 1) AS source, 'B' || year(o_orderdate) AS batch,
               'P' || (o_custkey % 20) AS plate, 'W' || (o_custkey % 96) AS well, o_orderkey AS site,
               'img/' || o_orderkey || '/dna' AS "URL_DNA",
               CASE WHEN o_orderstatus <> 'P' THEN 'img/' || o_orderkey || '/rna' END AS "URL_RNA" FROM orders)""",
}


def with_ctes(sql: str) -> str:
    """Replace ``{name}`` by the fixture's CTE text."""
    for name, text in CTES.items():
        sql = sql.replace("{" + name + "}", text)
    return positive_zero(sql)


def positive_zero(sql: str) -> str:
    """Wrap every ``round(...)`` so that the oracle never returns negative zero, and always a double."""
    out, i = [], 0
    while (at := sql.find("round(", i)) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[i:at], "(round(", positive_zero(sql[at + len("round("):end - 1]), ") + 0.0::DOUBLE)"]
        i = end
    return "".join(out) + sql[i:]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison, with negative zero folded into zero."""
    col = F.col(col) if isinstance(col, str) else col
    rounded = F.round(col, digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


# ---- the normal quantile as SQL text for the oracle ----------------------------------------------

def _horner(coef, x: str) -> str:
    text = f"{coef[-1]!r}::DOUBLE"
    for c in reversed(coef[:-1]):
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_quantile_sql(p: str) -> str:
    from phenospark.functions import scalar as sc

    q, tail = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1.0::DOUBLE - {p})))"
    ratio = lambda num, den, x: f"{_horner(num, x)} / {_horner(den, x)}"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(sc._CENTRE_NUM, sc._CENTRE_DEN, f'(0.180625::DOUBLE - {q} * {q})')} "
            f"WHEN {tail} <= 5.0 THEN sign({q}) * {ratio(sc._MIDDLE_NUM, sc._MIDDLE_DEN, f'({tail} - 1.6::DOUBLE)')} "
            f"ELSE sign({q}) * {ratio(sc._TAIL_NUM, sc._TAIL_DEN, f'({tail} - 5.0::DOUBLE)')} END")
