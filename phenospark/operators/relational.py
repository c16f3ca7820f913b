"""Projections, joins, set operations and deterministic sampling on DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import NumericType

META_PREFIX = "Metadata_"


# ---- projections -----------------------------------------------------------------------------

def infer_columns(df: DataFrame, prefixes: str | Sequence[str] = META_PREFIX) -> tuple[list[str], list[str]]:
    """(feature columns, metadata columns) split by name prefix."""
    prefixes = (prefixes,) if isinstance(prefixes, str) else tuple(prefixes)
    meta = [c for c in df.columns if c.startswith(prefixes)]
    return [c for c in df.columns if c not in meta], meta


def numeric_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    wanted = set(df.columns if names is None else names)
    return [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, NumericType)]


def select_matching(df: DataFrame, *patterns: str) -> DataFrame:
    """Columns matching any of the patterns, in pattern order."""
    picked: list[str] = []
    for p in patterns:
        picked += [c for c in df.columns if re.search(p, c) and c not in picked]
    return df.select(*picked)


def order_columns(df: DataFrame, order: Sequence[str], keep_rest: bool = False) -> DataFrame:
    first = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in first] if keep_rest else []
    return df.select(*first, *rest)


def add_prefix(df: DataFrame, names: Iterable[str], prefix: str = META_PREFIX) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in names if not c.startswith(prefix)})


def tag(df: DataFrame, **literals) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in literals.items()})


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def control_flag(df: DataFrame, type_col: str, compound_col: str, control_ids: Sequence,
                 control_key: str = "negcon", out: str = "Metadata_negcon") -> DataFrame:
    """Control type from the type column, else from the compound id; plus a boolean flag."""
    by_id = F.when(F.col(compound_col).isin(list(control_ids)), control_key).otherwise("trt")
    given = F.col(type_col) if type_col in df.columns else F.lit(None).cast("string")
    df = df.withColumn(type_col, F.coalesce(given, by_id))
    return df.withColumn(out, F.col(type_col) == control_key)


def choose(cases: Mapping[str, Column] | Sequence[tuple[Column, object]], default=None) -> Column:
    """Chained ``when``: first matching case wins."""
    pairs = [(c, v) for v, c in cases.items()] if isinstance(cases, Mapping) else list(cases)
    expr = F
    for cond, value in pairs:
        expr = expr.when(cond, value)
    return expr.otherwise(default)


def filter_panel(df: DataFrame, **panel) -> DataFrame:
    """Equality on each panel column where None means IS NULL."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in panel.items()]))


def restrict_to_split(df: DataFrame, is_compound: Column, ids: DataFrame, key: str) -> DataFrame:
    """Compounds are kept only when listed; all other rows pass untouched."""
    flagged = df.withColumn("_cmp", F.coalesce(is_compound, F.lit(False)))
    kept = flagged.filter("_cmp").join(ids.select(key).distinct(), key, "left_semi")
    return flagged.filter("NOT _cmp").unionByName(kept).drop("_cmp")


def nearest_threshold(df: DataFrame, wanted: float, col: str = "thresh") -> DataFrame:
    """Rows at the available threshold closest to the wanted one."""
    pick = df.select(F.min_by(col, F.struct(F.abs(F.col(col) - wanted), F.col(col)))).scalar()
    return df.filter(F.col(col) == pick)


def percentile_band(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Rows between two percentiles of a column."""
    from phenospark.operators.aggregate import group_quantiles

    bounds = with_row(df, group_quantiles(df.select(col), [], col, [low, high], ["lo", "hi"]), "_b")
    return bounds.filter(F.col(col).between(F.col("_b.lo"), F.col("_b.hi"))).drop("_b")


def with_row(df: DataFrame, one: DataFrame, name: str) -> DataFrame:
    """Adds a one-row table as a struct column (a scalar subquery, not a join)."""
    return df.withColumn(name, one.select(F.struct(*one.columns)).scalar())


def min_group_size(df: DataFrame, keys: Sequence[str], at_least: int) -> DataFrame:
    """Rows of groups with enough members; the count pre-aggregates and joins back."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least).drop("_n")
    return df.join(big, list(keys), "left_semi")


# ---- joins -----------------------------------------------------------------------------------

def enrich(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
           prefer: str = "left", order: Sequence[str] = ()) -> DataFrame:
    """Equi join on string-cast keys with one right row per key.

    ``prefer`` decides whose column survives when both sides carry it. The right row per key is the
    first in ``order`` (then in column order), so reruns agree.
    """
    keys = [k for k in keys if k in df.columns and k in right.columns]
    if not keys:
        raise ValueError("no common key columns")
    right = right.withColumns({k: F.col(k).cast("string") for k in keys})
    df = df.withColumns({k: F.col(k).cast("string") for k in keys})
    common = [c for c in right.columns if c in df.columns and c not in keys]
    if prefer == "left":
        right = right.drop(*common)
    else:
        df = df.drop(*common)
    return df.join(first_per_key(right, keys, order), keys, how)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Deterministic dedupe: smallest row per key by ``order`` and then all other columns.

    ``min`` of a struct combines map-side, so a hot key costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    by = [c for c in order] + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*by)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join where NULL keys match NULL keys."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def refresh_columns(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the columns of ``old`` that ``new`` also has."""
    stale = [c for c in new.columns if c in old.columns and c not in keys]
    return old.drop(*stale).join(new, list(keys), "left")


def pairs_in_group(df: DataFrame, keys: Sequence[str], id_col: str, block: int = 2048, widest: int = 64) -> DataFrame:
    """Ordered pairs (a, b), a <> b, of members of the same group, each once. NULL keys or ids belong to no group.

    The pairs are the result itself, so the work must not exceed them. A group is cut into hash blocks of about ``block``
    members, and a task gets one block against another, each unordered pair once: a hot group is more tasks of the same size.
    A pair that shares several groups is written in the smallest of them, which both members know from their own lists
    of groups, so the pairs need no ``distinct``. Only members of more than ``widest`` groups carry no list;
    their pairs with members of several groups are made apart and made distinct there.
    """
    from phenospark.session import materialize

    keys = list(keys)
    group = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    rows = materialize(df.select(*keys, F.col(id_col).alias("_m")).dropna().distinct(), "members")
    blocks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_nb"))
    members = rows.join(blocks, keys).withColumn("_at", F.pmod(F.xxhash64("_m"), F.col("_nb").cast("bigint")).cast("int"))
    reach = members.groupBy("_m").agg(F.count(F.lit(1)).alias("_of"))
    lists = (members.join(reach.filter(F.col("_of").between(2, widest)), "_m")
             .groupBy("_m").agg(F.collect_list(group).alias("_in")))
    members = materialize(members.join(reach.join(lists, "_m", "left"), "_m"), "members")
    light = members.filter(F.col("_of") <= widest)

    def tiles(left: DataFrame, right: DataFrame, i: Column, j: Column) -> DataFrame:
        """Members of a block meet those of another; i and j are the other blocks that each side goes to."""
        a = left.select(*keys, F.col("_m").alias("a"), F.col("_in").alias("_ia"), F.col("_at").alias("_i"), F.explode(j).alias("_j"))
        b = right.select(*keys, F.col("_m").alias("b"), F.col("_in").alias("_ib"), F.col("_of").alias("_ob"), F.col("_at").alias("_j"), F.explode(i).alias("_i"))
        return a.join(b, [*keys, "_i", "_j"])

    first = F.array_min(F.array_intersect("_ia", "_ib"))  # NULL where a member has one group only
    once = (tiles(light, light, F.sequence(F.lit(0), F.col("_at")), F.sequence(F.col("_at"), F.col("_nb") - 1))
            .filter((F.col("_i") < F.col("_j")) | (F.col("a") < F.col("b"))).filter(first.isNull() | (first == group)))
    both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    every = F.sequence(F.lit(0), F.col("_nb") - 1)
    wide = tiles(members.filter(F.col("_of") > widest), members, every, every).filter("a <> b")
    wide = wide.select("a", "b", (F.col("_ob") <= widest).alias("_light")).distinct()
    mirrored = wide.filter("_light").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return once.select(both).unionByName(wide.select("a", "b")).unionByName(mirrored)


def class_pairs_in_group(df: DataFrame, keys: Sequence[str], id_col: str, block: int = 2048, widest: int = 64) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``pairs_in_group`` between classes: (links (a, b), members (rep, id)).

    Members of exactly the same groups have the same partners, so they are one class, named by its smallest member. A link
    (a, b) stands for the pairs of each member of a's class with each of b's, a link (a, a) for those of different members
    of one class; together they are the ordered pairs, each once. The work follows the rows and the pairs of classes, not
    the pairs of members. A member of more than ``widest`` groups, or without an equal, is a class of its own.
    """
    from phenospark.session import materialize

    keys = list(keys)
    group = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    rows = materialize(df.select(*keys, F.col(id_col).alias("_m")).dropna().distinct(), "members")
    reach = rows.groupBy("_m").agg(F.count(F.lit(1)).alias("_of"))
    light = rows.join(reach.filter(F.col("_of") <= widest), "_m").groupBy("_m").agg(F.sort_array(F.collect_list(group)).alias("_in"))
    named = light.join(light.groupBy("_in").agg(F.min("_m").alias("rep")), "_in").select("rep", F.col("_m").alias("id"))
    alone = reach.filter(F.col("_of") > widest).select(F.col("_m").alias("rep"), F.col("_m").alias("id"))
    members = materialize(named.unionByName(alone), "classes")
    reps = rows.join(members.filter("rep = id").select(F.col("id").alias("_m")), "_m", "left_semi")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return pairs_in_group(reps, keys, "_m", block, widest).unionByName(several), members


# ---- sets ------------------------------------------------------------------------------------

def symmetrize(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct union of the edges and their mirror images."""
    others = [c for c in df.columns if c not in (a, b)]
    mirror = df.select(F.col(b).alias(a), F.col(a).alias(b), *others)
    return df.select(a, b, *others).union(mirror).distinct()


def canonical_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs as (lo, hi), without self pairs."""
    others = [c for c in df.columns if c not in (a, b)]
    return (df.filter(F.col(a) != F.col(b))
            .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), *others).distinct())


def key_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of shared and one-sided keys by one aggregation over both key sets."""
    both = (a.select(*keys).withColumns({"_a": F.lit(1), "_b": F.lit(0)})
            .unionByName(b.select(*keys).withColumns({"_a": F.lit(0), "_b": F.lit(1)}))
            .groupBy(*keys).agg(F.max("_a").alias("a"), F.max("_b").alias("b")))
    return both.agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
    )


def missing_and_extra(actual: DataFrame, canonical: DataFrame, keys: Sequence[str]) -> DataFrame:
    miss = canonical.select(*keys).distinct().join(actual, list(keys), "left_anti").withColumn("status", F.lit("missing"))
    extra = actual.select(*keys).distinct().join(canonical, list(keys), "left_anti").withColumn("status", F.lit("extra"))
    return miss.unionByName(extra)


def membership_patterns(steps: DataFrame, step_names: Sequence[str], step_col: str, id_col: str) -> DataFrame:
    """How many ids show each pattern of presence over the steps."""
    flags = steps.groupBy(id_col).agg(
        *[F.max((F.col(step_col) == s).cast("int")).alias(s) for s in step_names])
    return flags.groupBy(*step_names).agg(F.count(F.lit(1)).alias("n_ids"))


# ---- ranks, top-k ----------------------------------------------------------------------------

def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group. ``row_number <= n`` plans a group limit before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def average_rank(col: str, keys: Sequence[str], descending: bool = False) -> Column:
    """Rank with ties sharing their mean rank."""
    order = F.col(col).desc() if descending else F.col(col)
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, col)) - 1) / 2


def order_by_list(col: str, order: Sequence[str]) -> Column:
    """Position of a value in a given order; unknown values come last."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return F.coalesce(F.element_at(table, F.col(col)), F.lit(len(order)))


# ---- sampling (hash ordered, so reruns and lost executors give the same rows) ------------------

def hash_order(keys: Sequence[str], seed: int) -> Column:
    """Hex digits of MD5 over the seed and the keys, joined by '|': an order that other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_fraction_per_group(df: DataFrame, group: Sequence[str], id_cols: Sequence[str],
                              fraction: float, seed: int = 0) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each group.

    Exact in two bounded steps. Hash ranks come from 2**12 hash buckets per group, so no group is
    sorted as one partition: bucket sizes locate the bucket that holds the cut, and only that
    bucket's rows are ranked.
    """
    group = list(group)
    h = df.withColumn("_h", hash_order(id_cols, seed)).withColumn("_bkt", F.substring("_h", 1, 3))
    sizes = h.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*group)
    cut = (sizes.withColumn("_before", F.sum("_c").over(w.orderBy("_bkt")) - F.col("_c"))
           .withColumn("_k", F.greatest(F.lit(1), F.floor(F.sum("_c").over(w) * fraction)))
           .filter(F.col("_before") < F.col("_k"))
           .select(*group, "_bkt", (F.col("_k") - F.col("_before")).alias("_take"), "_c"))
    near = h.join(cut, [*group, "_bkt"])
    whole = near.filter("_take >= _c")
    part = (near.filter("_take < _c")
            .withColumn("_rn", F.row_number().over(W.partitionBy(*group, "_bkt").orderBy("_h", *id_cols)))
            .filter("_rn <= _take").drop("_rn"))
    return whole.unionByName(part).select(*df.columns)


def nested_subsample(df: DataFrame, treatment: str, is_control: Column, plate: str, n: int, seed: int = 0) -> DataFrame:
    """The first n treatments of a seeded permutation, with the controls of their plates."""
    picked = (df.filter(~is_control).select(treatment).distinct()
              .orderBy(hash_order([treatment], seed), treatment).limit(n))
    rows = df.filter(~is_control).join(picked, treatment, "left_semi")
    controls = df.filter(is_control).join(rows.select(plate).distinct(), plate, "left_semi")
    return rows.unionByName(controls)


def random_bucket(keys: Sequence[str], n: Column | int, seed: int = 0) -> Column:
    """Bucket 1..n from a hash of the keys."""
    n = F.lit(n) if isinstance(n, int) else n
    unsigned = F.conv(F.substring(hash_order(keys, seed), 1, 15), 16, 10).cast("bigint")
    return (F.pmod(unsigned, n.cast("bigint")) + 1).cast("int")


def random_k(df: DataFrame, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(keys, seed), *keys).limit(k)
