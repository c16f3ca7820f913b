"""Average precision of replicate retrieval, permutation nulls, and the effects built on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phenospark.operators import pairs as pr
from phenospark.operators.aggregate import group_median
from phenospark.operators.frame import ProfileFrame
from phenospark.operators.linalg import to_list_array
from phenospark.operators.ordered import running_least, running_sums
from phenospark.operators.relational import null_safe_join, random_bucket
from phenospark.session import materialize


@dataclass(frozen=True)
class PairRule:
    """Partners share the ``same`` columns and differ in each ``differ`` column; ``where`` limits the partners."""

    same: tuple[str, ...]
    differ: tuple[str, ...] = ()
    where: Column | None = None


def pick_metric(width: int) -> str:
    """Angles say little in one or two dimensions."""
    return "euclidean" if width <= 2 else "cosine"


def _prepared(pf: ProfileFrame, metric: str) -> DataFrame:
    v = pr.unit(F.col("features")) if metric == "cosine" else F.col("features")
    return pf.df.withColumn("features", v)


def precision_of_hits(hits: Column) -> Column:
    """Average precision from (step, n, above) entries in descending step order; positives lead their ties."""

    def add(acc, x):
        run = F.aggregate(F.sequence(F.lit(1).cast("bigint"), x["n"]), F.lit(0.0),
                          lambda s, i: s + (acc["p"] + i) / (acc["p"] + i + x["above"]))
        part = F.when(x["above"] == 0, x["n"].cast("double")).otherwise(run)
        return F.struct((acc["p"] + x["n"]).alias("p"), (acc["s"] + part).alias("s"))

    start = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0.0).alias("s"))
    return F.aggregate(hits, start, add, lambda acc: acc["s"] / acc["p"])


def harmonic(n: Column) -> Column:
    """Harmonic number: a small table, then the asymptotic series (error below 1e-14)."""
    table = F.array(*[F.lit(float(sum(1.0 / i for i in range(1, k + 1)))) for k in range(0, 41)])
    x = n.cast("double")
    series = F.log(x) + F.lit(0.57721566490153286) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 40, F.get(table, n.cast("int"))).otherwise(series)


def expected_precision(r: Column, n: Column) -> Column:
    """Mean average precision of r positives randomly placed among n candidates."""
    h = harmonic(n)
    return F.when(n > 1, (h + (n - h) * (r - 1) / (n - 1)) / n).otherwise(F.lit(1.0))


def average_precision(pf: ProfileFrame, positive: PairRule, negative: PairRule, query: Column | None = None,
                      metric: str | None = None, resolution: float = pr.RESOLUTION, block: int = pr.BLOCK_ROWS) -> DataFrame:
    """Rows with at least one positive partner, with their pair counts, AP and normalized AP.

    For each query the smaller side (positives or negatives) gives the thresholds and the larger side is only
    counted against them, so a compound or a plate with a third of all rows does not write out its pairs.
    """
    metric = metric or pick_metric(pf.width)
    rid, keep = "_rid", pf.meta
    # A short number names the row inside; it is written once and so stays the same for every reader.
    df = materialize(_prepared(pf, metric).withColumn("_rid", F.monotonically_increasing_id()), "pairs")
    queries = df.filter(query) if query is not None else df
    pos_refs, neg_refs = (df.filter(r.where) if r.where is not None else df for r in (positive, negative))
    sized = pr.partner_counts(queries, pos_refs, positive.same, "_np")
    sized = pr.partner_counts(sized, neg_refs, negative.same, "_nn").filter("_np > 0")
    sized = materialize(sized, "queries")
    few_pos = F.col("_np") <= F.col("_nn")
    n_few_pos, n_rest = sized.agg(F.count_if(few_pos), F.count_if(~few_pos)).first()
    parts = []
    if n_few_pos or not n_rest:
        # Queries carry their place among the negatives, so their steps go there at once.
        asking = pr.side(sized.filter(few_pos), rid, positive.same, positive.differ, carry=pr.place(rid, negative.same, negative.differ))
        hist = pr.similarity_histogram(asking, pr.side(pos_refs, rid, positive.same, positive.differ), pf.width, metric, resolution, block)
        parts.append(rank_placed_hits(hist, rid, negative, neg_refs, pf.width, metric, resolution, block))
    if n_rest:
        parts.append(rank_misses(sized.filter(~few_pos), rid, positive, pos_refs, negative, neg_refs, pf.width, metric, resolution, block))
    ap = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return queries.select(rid, *keep).join(ap.withColumnRenamed("_id", rid), rid).drop(rid)


def rank_placed_hits(hist: DataFrame, rid: str, negative: PairRule, refs: DataFrame, width: int, metric: str, resolution: float, block: int) -> DataFrame:
    """AP per ``_id`` of the histogram, whose queries carry their place among the negatives: their steps go there as thresholds,
    and the sizes of their hits are carried on."""
    asked = pr.placed_side(hist, ascending_thresholds(F.col("_list")["step"]), F.col("_list")["n"])
    above = pr.count_above(asked, pr.side(refs, rid, negative.same, negative.differ), width, metric, resolution, block, steps=False)
    zero = F.lit(0).cast("bigint")
    found = above.select("_id", F.col("_carry").alias("_n"), F.col("_list")[0].alias("_total"), F.slice("_list", 2, F.size("_list")).alias("_above"))
    hits = F.reverse(F.zip_with("_n", "_above", lambda n, a: F.struct(n.alias("n"), F.coalesce(a, zero).alias("above"))))
    n_pos = F.aggregate("_n", zero, lambda a, n: a + n)
    out = found.select("_id", n_pos.alias("n_pos_pairs"), (n_pos + F.coalesce("_total", zero)).alias("n_total_pairs"),
                       precision_of_hits(hits).alias("average_precision"))
    return with_normalized(out)


def rank_misses(queries: DataFrame, rid: str, positive: PairRule, pos_refs: DataFrame, negative: PairRule, neg_refs: DataFrame,
                width: int, metric: str, resolution: float, block: int) -> DataFrame:
    """AP per query from its negative steps and the positives at or above each of them.

    Between two neighbouring negatives the hits form a run whose sum of precisions is a difference of harmonic numbers.
    """
    misses = pr.similarity_histogram(pr.side(queries, rid, negative.same, negative.differ),
                                     pr.side(neg_refs, rid, negative.same, negative.differ), width, metric, resolution, block)
    # Steps travel to the tiles only, counts come back alone in the order of the steps.
    steps = misses.select(F.col("_id").alias(rid), F.col("_list")["step"].alias("_steps"))
    none = F.array().cast("array<bigint>")
    asked = queries.join(steps, rid, "left").withColumn("_thr", ascending_thresholds(F.coalesce("_steps", none)))
    above = pr.count_above(pr.side(asked, rid, positive.same, positive.differ, thresholds="_thr"),
                           pr.side(pos_refs, rid, positive.same, positive.differ), width, metric, resolution, block, or_equal=True, steps=False)
    sizes = misses.select("_id", F.col("_list")["n"].alias("_n"))
    joined = _counts_in_order(above, "_id").join(sizes, "_id", "left").withColumn("_n", F.coalesce("_n", none))

    def run(a, b, j):
        """Sum of i / (i + j) for hits a+1 .. b behind j misses."""
        return (b - a) - j * (harmonic(b + j) - harmonic(a + j))

    def add(acc, x):
        return F.struct((acc["j"] + x["n"]).alias("j"), x["hits"].alias("c"),
                        (acc["s"] + run(acc["c"], x["hits"], acc["j"])).alias("s"))

    zero = F.lit(0).cast("bigint")
    ordered = F.reverse(F.zip_with("_n", "_above", lambda n, a: F.struct(n.alias("n"), a.alias("hits"))))
    state = F.aggregate(ordered, F.struct(zero.alias("j"), zero.alias("c"), F.lit(0.0).alias("s")), add)
    out = joined.select("_id", F.col("_total").alias("n_pos_pairs"), state.alias("_st")).filter("n_pos_pairs > 0")
    r, st = F.col("n_pos_pairs"), F.col("_st")
    out = out.select("_id", "n_pos_pairs", (r + st["j"]).alias("n_total_pairs"),
                     ((st["s"] + run(st["c"], r, st["j"])) / r).alias("average_precision"))
    return with_normalized(out)


def ascending_thresholds(steps: Column) -> Column:
    """The threshold below everything and ascending steps; the step of an undefined similarity lies below even that."""
    both = F.concat(F.array(F.lit(pr.EVERYTHING)), steps)
    return F.when(F.get(steps, F.lit(0)) < pr.EVERYTHING, F.sort_array(both)).otherwise(both)


def _counts_in_order(above: DataFrame, key: str) -> DataFrame:
    """Per query the counts by ascending threshold, and the total from the threshold below everything."""
    total = F.col("_list")[0]
    paired = isinstance(above.schema["_list"].dataType.elementType, T.StructType)
    return above.select(F.col("_id").alias(key), (total["above"] if paired else total).alias("_total"),
                        F.slice("_list", 2, F.size("_list")).alias("_above"))


def with_normalized(ap: DataFrame) -> DataFrame:
    """Adds (AP - expected) / (1 - expected); NULL when every candidate is a positive."""
    e = expected_precision(F.col("n_pos_pairs"), F.col("n_total_pairs"))
    return ap.withColumn("normalized_average_precision",
                         F.when(F.col("n_total_pairs") > F.col("n_pos_pairs"), (F.col("average_precision") - e) / (1 - e)))


def rank_hits(hist: DataFrame, queries: DataFrame, rid: str, negative: PairRule, refs: DataFrame, width: int,
              metric: str, resolution: float, block: int, owner: Column, labels: str | None = None) -> DataFrame:
    """AP per ``_id`` of the histogram from its positive steps and the negatives above each of them.

    ``owner`` gives the row an ``_id`` belongs to, as several share one row; the row is compared once with
    the thresholds of all of them. A list holds one entry per distinct step, so it is bounded by the grid.
    """
    per_id = hist.withColumnRenamed("_list", "_hits").withColumn("_owner", owner)
    steps = F.array_distinct(F.flatten(F.collect_list(F.col("_hits")["step"])))
    thresholds = per_id.groupBy("_owner").agg(F.concat(F.array(F.lit(pr.EVERYTHING)), steps).alias("_thr"))
    asked = queries.join(thresholds.withColumnRenamed("_owner", rid), rid)
    above = pr.count_above(
        pr.side(asked, rid, negative.same, negative.differ, labels=labels, thresholds="_thr"),
        pr.side(refs, rid, negative.same, negative.differ, labels=labels), width, metric, resolution, block,
        exclude_shared_labels=labels is not None)
    found = _counts_in_order(above, "_owner")
    zero = F.lit(0).cast("bigint")
    joined = per_id.join(found, "_owner", "left")
    n_pos = F.aggregate("_hits", zero, lambda a, h: a + h["n"])
    hits = F.reverse(_placed_hits(F.col("_both")))
    joined = joined.withColumn("_both", _hits_behind_thresholds(F.col("_hits"), F.coalesce("_above", F.array().cast(found.schema["_above"].dataType))))
    out = joined.select(
        "_id", n_pos.alias("n_pos_pairs"), (n_pos + F.coalesce("_total", zero)).alias("n_total_pairs"),
        precision_of_hits(hits).alias("average_precision"))
    return with_normalized(out)


def _hits_behind_thresholds(hits: Column, above: Column) -> Column:
    """Hits and counted thresholds in one ascending list, a hit right behind the threshold of its step."""
    zero = F.lit(0).cast("bigint")
    entry = lambda x, n, a: F.struct(x["step"].alias("step"), n.alias("n"), a.alias("above"))
    return F.sort_array(F.concat(F.transform(above, lambda x: entry(x, zero, x["above"])), F.transform(hits, lambda x: entry(x, x["n"], zero))))


def _placed_hits(both: Column) -> Column:
    """The hits (n, above) of such a list, which is looked through once; a map of the thresholds would be for each hit."""

    def place(x, i):
        before = F.get(both, i - 1)
        known = (before["n"] == 0) & (before["step"] == x["step"])
        return F.struct(x["n"].alias("n"), F.when(known, before["above"]).otherwise(F.lit(0).cast("bigint")).alias("above"))

    return F.filter(F.transform(both, place), lambda x: x["n"] > 0)


# ---- permutation nulls -----------------------------------------------------------------------------

def distinct_places(rng: np.random.Generator, m: int, k: int, n: int) -> np.ndarray:
    """m rows of k different places among n, ascending, each set equally likely.

    Places are drawn until k different ones are there, so time and memory follow k and not n.
    """
    found = np.sort(rng.integers(0, n, size=(m, k)), axis=1)
    while k > 1:
        again = np.zeros((m, k), bool)
        again[:, 1:] = found[:, 1:] == found[:, :-1]
        rows = np.flatnonzero(again.any(axis=1))
        if not len(rows):
            break
        part = found[rows]
        part[again[rows]] = rng.integers(0, n, size=int(again.sum()))
        found[rows] = np.sort(part, axis=1)
    return found


def random_precisions(r: int, n: int, size: int, seed: int) -> np.ndarray:
    """``size`` average precisions of r positives placed at random among n; the same for the same arguments.

    The places of the rarer kind are drawn. Hits between two misses have precisions whose sum is a difference of harmonic
    numbers, so misses are as good as hits.
    """
    if r >= n:
        return np.ones(size)
    rng, out, k = np.random.default_rng([seed, r, n]), np.empty(size), min(r, n - r)
    step = max(1, 2_000_000 // k)
    h = np.r_[0.0, np.cumsum(1.0 / np.arange(1, n + 1))] if r > k else None
    for a in range(0, size, step):
        places = distinct_places(rng, min(step, size - a), k, n)
        if r == k:
            out[a:a + step] = (np.arange(1, r + 1) / (places + 1)).mean(axis=1)
        else:  # before the j-th miss (from 0) lie places - j hits; the last run ends with hit r
            j = np.arange(k + 1)
            hits = np.concatenate([places - j[:-1], np.full((len(places), 1), r)], axis=1)
            before = np.concatenate([np.zeros((len(places), 1), dtype=np.int64), hits[:, :-1]], axis=1)
            out[a:a + step] = ((hits - before) - j * (h[hits + j] - h[before + j])).sum(axis=1) / r
    return out


NULL_KEYS = ("n_pos_pairs", "n_total_pairs")


def null_table(pairs: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(n_pos_pairs, n_total_pairs, draws): one row per different pair of counts, made once, on the executors."""
    different = pairs.select(*NULL_KEYS).distinct()
    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def draw(batches):
        for b in batches:
            for r, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([total]), to_list_array(random_precisions(r, total, size, seed)[None, :])],
                                                 names=[*NULL_KEYS, "draws"])

    schema = "n_pos_pairs long, n_total_pairs long, draws array<double>"
    return materialize(different.repartition(n, *NULL_KEYS).mapInArrow(draw, schema), "nulls")


# Bytes of draws a task holds, and (group, pair of counts) cells it compares with them.
NULL_BYTES, NULL_CELLS = 64 << 20, 200_000


def with_p_values(df: DataFrame, configs: str, observed: str, nulls: DataFrame, held: int = NULL_BYTES, cells: int = NULL_CELLS) -> DataFrame:
    """p = (1 + nulls at least as large) / (1 + null size).

    ``configs`` is an array of (n_pos_pairs, n_total_pairs, weight); a group's null is the weighted mean of its members' draws.
    ``df`` and ``nulls`` are read several times and must be stored tables. Groups are cut into parts, and each part's stream
    begins with the draws, so a group's own null is never written. Draws beyond ``held`` bytes are cut by their numbers: a
    task then compares its groups with a slice of each null, and the counts of the slices are added.
    """
    spark, columns = df.sparkSession, df.columns
    n_cells, n_rows = df.agg(F.sum(F.size(configs)), F.count(F.lit(1))).first()
    n_kinds, size = nulls.agg(F.count(F.lit(1)), F.max(F.size("draws"))).first()
    n_cells, drawn = n_cells or 0, n_kinds * (size or 0) * 8
    slices = max(1, min(size or 1, -(-drawn // held)))
    length = -(-(size or 1) // slices)
    slices = -(-(size or 1) // length)
    # Copies of the draws weigh no more than the groups do, unless the cores need them.
    most = max(spark.sparkContext.defaultParallelism, 2 * slices * (24 * n_cells + 100 * n_rows) // max(drawn, 1))
    parts = max(1, min(n_cells // cells + 1, most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    heads = (nulls.select(*NULL_KEYS, "draws", every(slices).alias("_slice"))
             .select(F.array(F.struct(*NULL_KEYS, F.lit(0).cast("bigint").alias("weight"))).cast(df.schema[configs].dataType).alias(configs),
                     F.slice("draws", F.col("_slice") * length + 1, length).alias("_draws"), "_slice", every(parts).alias("_part")))
    rows = df.withColumns({"_part": F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"), "_row": F.monotonically_increasing_id(),
                           "_draws": F.lit(None).cast("array<double>")})
    if slices > 1:  # numbers of rows outlive the cut
        rows = materialize(rows, "tests")
    rows = rows.withColumn("_slice", every(slices))
    both = heads.unionByName(rows, allowMissingColumns=True).select(*columns, "_draws", "_row", "_part", "_slice")
    order = ["_part", "_slice", F.col("_row").isNotNull(), configs]
    both = both.repartition(parts * slices, "_part", "_slice").sortWithinPartitions(*order)
    at, of_config, width = columns.index(observed), columns.index(configs), len(columns)

    def compare(batches):
        unit, draws = None, None
        for b in batches:
            if not b.num_rows:
                continue
            units = [b.column(width + i).to_numpy(zero_copy_only=False) for i in (2, 3)]
            edges = np.r_[0, np.flatnonzero(np.diff(units[0]) | np.diff(units[1])) + 1, b.num_rows]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (units[0][lo], units[1][lo]) != unit:
                    unit, draws = (units[0][lo], units[1][lo]), _Draws()
                part = b.slice(lo, hi - lo)
                n_heads = part.column(width + 1).null_count
                if n_heads:
                    draws.add(part.column(of_config).slice(0, n_heads), part.column(width).slice(0, n_heads))
                if n_heads < part.num_rows:
                    part = part.slice(n_heads)
                    beyond = draws.beyond(part.column(of_config), part.column(at).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], part.column(width + 1), pa.array(beyond)], names=[*columns, "_row", "_beyond"])

    schema = T.StructType([*df.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_beyond", T.LongType())])
    found = both.mapInArrow(compare, schema)
    p_value = ((F.lit(1) + F.col("_beyond")) / F.lit(1 + (size or 0))).alias("p_value")
    if slices > 1:
        sums = found.groupBy("_row").agg(F.sum("_beyond").alias("_beyond"))
        found = rows.filter("_slice = 0").join(sums, "_row")
    return found.select(*columns, p_value)


class _Draws:
    """The draws of all pairs of counts, and how many of a weighted mean of them are at least as large as a value."""

    def __init__(self):
        self.parts, self.table = [], None

    @staticmethod
    def _cells(configs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = configs.flatten()
        lengths = configs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return (*(flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)), np.r_[0, np.cumsum(lengths)])

    def add(self, configs: pa.ListArray, draws: pa.ListArray) -> None:
        pos, total, _, _ = self._cells(configs)
        self.parts.append((pos, total, draws.flatten().to_numpy(zero_copy_only=False).reshape(len(pos), -1)))

    def _closed(self) -> None:
        if self.table is None:
            pos, total = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            self.table = np.concatenate([p[2] for p in self.parts])
            self.parts = []
            self.known_pos, self.known_total = np.unique(pos), np.unique(total)
            codes = self._code(pos, total)[0]
            self.order = np.argsort(codes, kind="stable")
            self.codes = codes[self.order]

    def _code(self, pos: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number per pair of counts, and whether both counts are known."""
        i, j = np.searchsorted(self.known_pos, pos), np.searchsorted(self.known_total, total)
        i, j = np.minimum(i, len(self.known_pos) - 1), np.minimum(j, len(self.known_total) - 1)
        return i * len(self.known_total) + j, (self.known_pos[i] == pos) & (self.known_total[j] == total)

    def beyond(self, configs: pa.ListArray, observed: np.ndarray) -> np.ndarray:
        self._closed()
        pos, total, weight, offsets = self._cells(configs)
        codes, known = self._code(pos, total)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        if not (known & (self.codes[place] == codes)).all():
            raise ValueError("a pair of counts has no draws")
        place, weight, out = self.order[place], weight.astype(np.float64), np.empty(len(observed), dtype=np.int64)
        # Neighbours of the same make-up share one null.
        lengths = np.diff(offsets)
        start = 0
        while start < len(observed):
            lo, hi, stop = offsets[start], offsets[start + 1], start + 1
            while stop < len(observed) and lengths[stop] == hi - lo:
                a = offsets[stop]
                if not (np.array_equal(place[a:a + hi - lo], place[lo:hi]) and np.array_equal(weight[a:a + hi - lo], weight[lo:hi])):
                    break
                stop += 1
            null = self._mean(place[lo:hi], weight[lo:hi])
            if stop - start == 1:
                out[start] = np.count_nonzero(null >= observed[start] - 1e-12)
            else:
                null.sort()
                out[start:stop] = len(null) - np.searchsorted(null, observed[start:stop] - 1e-12, side="left")
            start = stop
        return out

    def _mean(self, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        step, total = max(1, (8 << 20) // (8 * self.table.shape[1])), np.zeros(self.table.shape[1])
        for a in range(0, len(place), step):
            total += weight[a:a + step] @ self.table[place[a:a + step]]
        return total / weight.sum()


def adjust_p_values(df: DataFrame, p: str = "p_value", out: str = "corrected_p_value", within: Sequence[str] = (), **kw) -> DataFrame:
    """False-discovery adjusted p-values (Benjamini and Hochberg) of p-values of any origin; NULL stays NULL.

    ``within`` columns separate families of tests. Equal p-values are counted first. Ranks are running sums over ranges of
    p, and the minimum over larger p-values is taken inside ranges first, then over them.
    """
    family = list(within)
    tests = df.filter(F.col(p).isNotNull())
    counts = tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, family, [p], {"_rank": F.col("_c")}, **kw)
    if family:
        ranked = null_safe_join(ranked, tests.groupBy(*family).agg(F.count(p).cast("double").alias("_m")), family)
    else:
        ranked = ranked.withColumn("_m", F.lit(float(tests.count())))
    raw = ranked.select(*family, p, (F.col(p) * F.col("_m") / F.col("_rank")).alias("_raw"))
    least = running_least(raw, family, p, "_raw", "_least")
    adjusted = null_safe_join(tests, least.select(*family, p, F.least(F.lit(1.0), F.col("_least")).alias(out)), [*family, p])
    return adjusted.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


benjamini_hochberg = adjust_p_values


def mean_average_precision(ap: DataFrame, by: Sequence[str], null_size: int = 10_000, threshold: float = 0.05,
                           seed: int = 0, nulls: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Mean AP per group with p-value, corrected p-value and a significance flag. ``nulls`` may give a table of draws (or make
    it from ``ap``), ``within`` columns whose values are corrected apart from each other."""
    cells = ap.groupBy(*by, *NULL_KEYS).agg(
        F.count(F.lit(1)).alias("weight"), F.sum("average_precision").alias("_ap"),
        F.sum("normalized_average_precision").alias("_nap"), F.count("normalized_average_precision").alias("_nn"))
    groups = cells.groupBy(*by).agg(
        (F.sum("_ap") / F.sum("weight")).alias("mean_average_precision"),
        (F.sum("_nap") / F.when(F.sum("_nn") > 0, F.sum("_nn"))).alias("mean_normalized_average_precision"),
        F.sum("weight").alias("n_rows"),
        F.sort_array(F.collect_list(F.struct(*NULL_KEYS, "weight"))).alias("_cfg"))
    groups = materialize(groups, "groups")
    if callable(nulls):
        nulls = nulls(ap)
    if nulls is not None:
        nulls = materialize(nulls, "nulls")
    else:
        nulls = null_table(groups.select(F.explode("_cfg").alias("m")).select("m.*"), null_size, seed)
    # Written once: the adjustment below reads the p-values several times.
    tested = materialize(with_p_values(groups, "_cfg", "mean_average_precision", nulls).drop("_cfg"), "tested")
    return adjust_p_values(tested, within=within).withColumn("below_corrected_p", F.col("corrected_p_value") < threshold)


def row_p_values(ap: DataFrame, null_size: int = 10_000, seed: int = 0, nulls: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """p-value of each row's own AP. ``nulls`` may give a table of draws, or make it from the written ``ap``."""
    one = F.array(F.struct(*NULL_KEYS, F.lit(1).cast("bigint").alias("weight")))
    ap = materialize(ap.withColumn("_cfg", one), "ap")
    nulls = nulls(ap) if callable(nulls) else nulls
    nulls = null_table(ap, null_size, seed) if nulls is None else materialize(nulls, "nulls")
    return with_p_values(ap, "_cfg", "average_precision", nulls).drop("_cfg")


# ---- phenotypic activity -----------------------------------------------------------------------------

def activity_precision(pf: ProfileFrame, compound: str, negcon: str, batch: str, group: str | None = None, **kw) -> DataFrame:
    """AP of treated rows: positives are replicates in the group, negatives the controls of plate and group."""
    g = (group,) if group else ()
    treated, control = ~F.col(negcon), F.col(negcon)
    return average_precision(pf, PairRule((compound, *g), (), treated), PairRule((batch, *g), (compound,), control),
                             query=treated, **kw)


def phenotypic_activity(pf: ProfileFrame, compound: str, negcon: str, batch: str, group: str | None = None, null_size: int = 10_000,
                        p_threshold: float = 0.05, seed: int = 0, nulls: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(AP per row, mean AP per compound with p-values)."""
    ap = materialize(activity_precision(pf, compound, negcon, batch, group, **kw), "activity")
    by = [compound, group] if group else [compound]
    return ap, mean_average_precision(ap, by, null_size, p_threshold, seed, nulls)


def activity_summary(map_df: DataFrame, by: Sequence[str], compound: str, replicates: str = "n_rows") -> DataFrame:
    """Per group: share and number of significant groups, mean, median and clipped mean of normalized AP."""
    nap = F.col("mean_normalized_average_precision")
    stats = map_df.groupBy(*by).agg(
        (F.avg(F.col("below_corrected_p").cast("double")) * 100).alias("pct_active"),
        F.count_if("below_corrected_p").alias("num_active"), F.avg(nap).alias("mean_nap"),
        F.avg(F.greatest(nap, F.lit(0.0))).alias("mean_nap_clipped"), F.avg(replicates).alias("mean_n_replicates"),
        F.countDistinct(compound).alias("n_unique_compounds"))
    for col, name in ((nap, "median_nap"), (F.col(replicates).cast("double"), "median_n_replicates")):
        med = group_median(map_df.select(*by, col.alias("_x")), by, "_x", name)
        stats = null_safe_join(stats, med, by) if by else stats.withColumn(name, med.scalar())
    return stats


# ---- phenotypic consistency --------------------------------------------------------------------------

def filter_targets(df: DataFrame, targets: str, compound: str, negcon: str | None = None, min_compounds: int = 3,
                   max_targets: int | None = None, exclude_unknown: bool = True, unknown: str = "unknown") -> DataFrame:
    """Controls and unlabelled rows out; lists shrink to targets with enough compounds.

    ``max_targets`` also leaves out promiscuous compounds, those with more targets than that.
    """
    rows = df.filter(~F.col(negcon)) if negcon else df
    rows = rows if max_targets is None else rows.filter(F.size(targets) <= max_targets)
    if exclude_unknown:
        rows = rows.withColumn(targets, F.array_remove(targets, unknown))
    rows = rows.filter(F.size(targets) > 0)
    exploded = rows.select(compound, F.explode(F.array_distinct(targets)).alias("_t")).distinct()
    enough = exploded.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_compounds).select("_t")
    lists = exploded.join(enough, "_t").groupBy(compound).agg(F.sort_array(F.collect_list("_t")).alias("_kept"))
    joined = rows.join(lists, compound)
    own = F.sort_array(F.array_intersect(targets, "_kept"))
    return joined.withColumn(targets, own).drop("_kept").filter(F.size(targets) > 0)


def multilabel_precision(pf: ProfileFrame, targets: str, group: str | None = None, metric: str | None = None,
                         resolution: float = pr.RESOLUTION, block: int = pr.BLOCK_ROWS,
                         background: Column | None = None) -> DataFrame:
    """AP per (row, label): positives share the label, negatives share none; partners lie in the same group.

    ``background`` marks rows that only serve as negatives.
    """
    metric = metric or pick_metric(pf.width)
    df = materialize(_prepared(pf, metric).withColumn("_rid", F.col(pf.id_col).cast("string")), "rows")
    same = (group,) if group else ()
    queries = df.filter(~background) if background is not None else df
    # Every (row, label) is an id of its own; the row is still compared with the negatives only once.
    tagged = (queries.withColumn("label", F.explode(F.array_distinct(targets)))
              .withColumn("_rl", F.concat_ws(LABEL_MARK, "label", "_rid")))
    members = pr.side(tagged, "_rl", (*same, "label"), self_col="_rid")
    hist = pr.similarity_histogram(members, members, pf.width, metric, resolution, block)
    ap = rank_hits(hist, queries, "_rid", PairRule(same), df, pf.width, metric, resolution, block, labels=targets,
                   owner=F.split_part("_id", F.lit(LABEL_MARK), F.lit(2)))
    names = tagged.select(F.col("_rl").alias("_id"), pf.id_col, "label", *same)
    return names.join(ap, "_id").drop("_id")


LABEL_MARK = "\u0001"


def phenotypic_consistency(pf: ProfileFrame, targets: str, compound: str, group: str | None = None, negcon: str | None = None,
                           null_size: int = 10_000, p_threshold: float = 0.05, seed: int = 0, min_compounds: int = 3,
                           max_targets: int | None = None, nulls: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(AP per row and label, mean AP per label and group with p-values) on consensus profiles."""
    rows = pf.with_df(filter_targets(materialize(pf.df, "targets"), targets, compound, negcon, min_compounds, max_targets))
    ap = materialize(multilabel_precision(rows, targets, group, **kw), "consistency")
    by = ["label", group] if group else ["label"]
    return ap, mean_average_precision(ap, by, null_size, p_threshold, seed, nulls)


def consistency_of_active(pf: ProfileFrame, activity: DataFrame, targets: str, compound: str, group: str | None = None,
                          at_least: int = 2, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consistency among compounds whose activity is significant: AP per row and label, mean AP, summary per group.

    ``activity`` is a table of phenotypic activity; a compound is let in if one of its groups has ``below_corrected_p``. With
    fewer than ``at_least`` such compounds nothing is let in.
    """
    active = materialize(activity.filter("below_corrected_p").select(compound).distinct(), "active")
    if active.limit(at_least).count() < at_least:
        active = active.limit(0)
    gated = pf.with_df(pf.df.join(active, compound, "left_semi"))
    ap, maps = phenotypic_consistency(gated, targets, compound, group, **kw)
    maps = materialize(maps, "gated")
    nap = "mean_normalized_average_precision"
    summary = maps.groupBy(*([group] if group else [])).agg(
        (F.avg(F.col("below_corrected_p").cast("double")) * 100).alias("pct_active"), F.count_if("below_corrected_p").alias("n_targets_active"),
        F.count("*").alias("n_targets_total"), F.avg(nap).alias("mean_nap"))
    return ap, maps, summary


def consistency_by_subset(pf: ProfileFrame, subsets: DataFrame, targets: str, compound: str, subset: str = "subset",
                          group: str | None = None, **kw) -> DataFrame:
    """Consistency AP within each named subset of compounds; the subset is one more part of every key."""
    both = pf.df.join(subsets.select(compound, subset).distinct(), compound)
    scope = F.concat_ws("/", subset, group) if group else F.col(subset)
    both = both.withColumn("_scope", scope).withColumn("_row", F.concat_ws("/", subset, F.col(pf.id_col).cast("string")))
    ap = multilabel_precision(ProfileFrame(both, pf.names, "_row"), targets, "_scope", **kw)
    return ap.withColumnRenamed("_scope", subset if not group else "scope").drop("_row")


# ---- position and plate effects ------------------------------------------------------------------------

def wells_on_plates(df: DataFrame, well: str, batch: str, group: str | None = None, at_least: int = 2) -> DataFrame:
    """Rows of positions that occur on enough plates."""
    keys = [group, well] if group else [well]
    ok = df.groupBy(*keys).agg(F.countDistinct(batch).alias("_n")).filter(F.col("_n") >= at_least).select(*keys)
    return df.join(ok, keys, "left_semi")


def several(df: DataFrame, column: str, group: str | None, at_least: int = 2) -> DataFrame:
    """Rows of the groups (without a group: all rows or none) in which a column has enough different values."""
    keys = [group] if group else [F.lit(0).alias("_all")]
    ok = df.groupBy(*keys).agg(F.countDistinct(column).alias("_n")).filter(F.col("_n") >= at_least)
    if group:
        return df.join(ok.select(group), group, "left_semi")
    return df.withColumn("_all", F.lit(0)).join(ok.select("_all"), "_all", "left_semi").drop("_all")


def _sampled(df: DataFrame, group: str | None, name: str, size: Column, id_col: str, seed: int) -> DataFrame:
    """A random bucket per row, as many per group as ``size`` says, 2 at least."""
    keys = [group] if group else [F.lit(0).alias("_all")]
    sizes = df.groupBy(*keys).agg(F.greatest(F.lit(2), F.floor(size)).cast("int").alias("_nb"))
    sized = df.join(sizes, group) if group else df.withColumn("_all", F.lit(0)).join(sizes, "_all").drop("_all")
    return sized.withColumn(name, random_bucket([id_col], F.col("_nb"), seed)).drop("_nb")


def position_effect(pf: ProfileFrame, well: str, batch: str, compound: str, group: str | None = None, bucket: Column | None = None,
                    rows_per_bucket: int | None = None, min_rows: int = 10, seed: int = 0, **kw) -> DataFrame:
    """AP of the same position on other plates against other positions of the plate.

    All negatives count unless ``rows_per_bucket`` asks for random buckets of about that many negatives per query (the sampled
    form of the measure) or ``bucket`` gives them. Groups with fewer than two positions on several plates are left out, and
    with fewer than ``min_rows`` rows there is no result.
    """
    g = (group,) if group else ()
    pf = pf.with_df(materialize(pf.df, "position"))
    df = several(wells_on_plates(pf.df, well, batch, group), well, group)
    if pf.df.limit(min_rows).count() < min_rows:
        df = df.limit(0)
    if bucket is None and rows_per_bucket:
        df = _sampled(df, group, "_bucket", F.count(F.lit(1)) / F.countDistinct(batch) / rows_per_bucket, pf.id_col, seed)
    else:
        df = df.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    return average_precision(pf.with_df(df), PairRule((*g, well), (batch, compound)),
                             PairRule((*g, batch, "_bucket"), (well, compound)), **kw)


def plate_effect(pf: ProfileFrame, well: str, batch: str, compound: str, group: str | None = None, pos_bucket: Column | None = None,
                 neg_bucket: Column | None = None, rows_per_bucket: tuple[int, int] | None = None, min_rows: int = 10,
                 seed: int = 0, **kw) -> DataFrame:
    """AP of the same plate against other plates, other positions and other compounds.

    All pairs count unless ``rows_per_bucket`` (positives, negatives) asks for random buckets or the buckets are given. Groups
    with one plate are left out, and with fewer than ``min_rows`` rows there is no result.
    """
    g = (group,) if group else ()
    pf = pf.with_df(materialize(pf.df, "plate"))
    df = several(pf.df, batch, group)
    if pf.df.limit(min_rows).count() < min_rows:
        df = df.limit(0)
    if rows_per_bucket and pos_bucket is None and neg_bucket is None:
        n = F.count(F.lit(1))
        df = _sampled(df, group, "_pos_bucket", n / F.countDistinct(batch) / rows_per_bucket[0], pf.id_col, seed)
        df = _sampled(df, group, "_neg_bucket", n / rows_per_bucket[1], pf.id_col, seed + 1)
    else:
        df = df.withColumn("_pos_bucket", F.lit(0) if pos_bucket is None else pos_bucket)
        df = df.withColumn("_neg_bucket", F.lit(0) if neg_bucket is None else neg_bucket)
    return average_precision(pf.with_df(df), PairRule((*g, batch, "_pos_bucket"), (compound,)),
                             PairRule((*g, "_neg_bucket"), (batch, well, compound)), **kw)
