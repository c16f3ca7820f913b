"""Permutation nulls, adjustment of any p-values, the significance gate and Spearman's p-value."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions.scalar import correlation_p_value
from phenospark.operators import evaluate as ev
from phenospark.operators import saturation as sat
from phenospark.operators.frame import ProfileFrame


@pytest.mark.parametrize("r,n", [(1, 2), (1, 5), (2, 6), (3, 7), (5, 7), (6, 7), (4, 8)])
def test_draws_follow_all_placements(r, n):
    """Both ways (places of hits, places of misses) against the mean and variance over every placement."""
    every = np.array([np.mean([(i + 1) / (p + 1) for i, p in enumerate(c)]) for c in itertools.combinations(range(n), r)])
    draws = ev.random_precisions(r, n, 20000, 3)
    assert abs(draws.mean() - every.mean()) < 5 * every.std() / 141 + 1e-9 and abs(draws.std() - every.std()) < 0.02
    assert set(np.round(draws, 9)) <= set(np.round(every, 9))


def test_places_are_different_and_even():
    rng = np.random.default_rng(0)
    found = ev.distinct_places(rng, 30000, 3, 5)
    assert (np.diff(found, axis=1) > 0).all()
    counts = np.unique(found @ np.array([25, 5, 1]), return_counts=True)[1]
    assert len(counts) == 10 and counts.min() > 2700 and counts.max() < 3300
    wide = ev.distinct_places(rng, 3, 1000, 10 ** 10)
    assert wide.max() < 10 ** 10 and (np.diff(wide, axis=1) > 0).all()


def test_p_values_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(r), int(r + 4), float(rng.random())) for i, r in enumerate(rng.integers(1, 4, 300))]
    found = []
    for parts in (1, 7):
        ap = spark.createDataFrame(rows, "i int, n_pos_pairs long, n_total_pairs long, average_precision double").repartition(parts)
        found.append({r.i: r.p_value for r in ev.row_p_values(ap, 500, seed=4).collect()})
    assert found[0] == found[1]
    for i, r, n, a in rows:
        assert np.isclose(found[0][i], (1 + (ev.random_precisions(r, n, 500, 4) >= a - 1e-12).sum()) / 501)


def test_groups_mix_the_draws_of_their_members(spark):
    rows = [("a", 1, 5, 0.3), ("a", 1, 5, 0.5), ("a", 2, 9, 0.9), ("b", 2, 9, 0.2), ("c", 1, 5, 0.8), ("c", 1, 5, 0.9), ("c", 2, 9, 0.4)]
    ap = spark.createDataFrame([(*r, 0.1) for r in rows], "g string, n_pos_pairs long, n_total_pairs long, average_precision double, normalized_average_precision double")
    got = {r.g: r.p_value for r in ev.mean_average_precision(ap, ["g"], null_size=400, seed=1).collect()}
    one, two = ev.random_precisions(1, 5, 400, 1), ev.random_precisions(2, 9, 400, 1)
    for g, null, value in (("a", (2 * one + two) / 3, 1.7 / 3), ("b", two, 0.2), ("c", (2 * one + two) / 3, 2.1 / 3)):
        assert np.isclose(got[g], (1 + (null >= value - 1e-12).sum()) / 401)


@pytest.mark.parametrize("limit", [10**9, 50])
def test_adjustment_of_any_p_values(spark, limit):
    rng = np.random.default_rng(7)
    p = np.round(rng.random(900), 3)
    p[::50] = 0.0
    rows = [(i, "xyz"[i % 3], float(v)) for i, v in enumerate(p)] + [(1000, "x", None)]
    df = spark.createDataFrame(rows, "i int, f string, p_value double").repartition(6)

    def plain(v):
        order = np.argsort(v)
        adj = np.minimum.accumulate((v[order] * len(v) / np.arange(1, len(v) + 1))[::-1])[::-1]
        out = np.empty(len(v))
        out[order] = np.minimum(adj, 1)
        return out

    got = {r.i: r.corrected_p_value for r in ev.adjust_p_values(df, direct_limit=limit).collect()}
    assert got.pop(1000) is None and np.allclose([got[i] for i in range(900)], plain(p))
    got = {r.i: r.corrected_p_value for r in ev.adjust_p_values(df, within=["f"], direct_limit=limit).collect()}
    for k in range(3):
        assert np.allclose([got[i] for i in range(k, 900, 3)], plain(p[k::3]))


def test_correlation_p_values(spark):
    """Tabulated critical values of Student's t, and limits."""
    tabulated = [(12.706205, 1), (4.302653, 2), (2.228139, 10), (2.042272, 30), (1.983972, 100), (1.962339, 1000)]
    rows = [(t / np.sqrt(f + t * t), f + 2, 0.05) for t, f in tabulated] + [(0.0, 12, 1.0), (1.0, 12, 0.0), (-1.0, 12, 0.0), (0.001, 10**6, 0.317311), (-0.5, 3, 0.666667)]
    df = spark.createDataFrame([(float(r), n, w) for r, n, w in rows], "r double, n long, want double")
    for r in df.withColumn("p", correlation_p_value(F.col("r"), F.col("n"))).collect():
        assert abs(r.p - r.want) < 2e-6, r
    few = spark.createDataFrame([(0.5, 2), (None, 9)], "r double, n long").withColumn("p", correlation_p_value(F.col("r"), F.col("n")))
    assert [r.p for r in few.collect()] == [None, None]


def test_gate_lets_in_only_significant_compounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"c{i % 6}", ["t0" if i % 6 < 3 else "t1"], rng.normal(size=6).tolist()) for i in range(60)]
    pf = ProfileFrame(spark.createDataFrame(rows, "row_id long, compound string, targets array<string>, features array<double>"), tuple("abcdef"))
    flags = spark.createDataFrame([(f"c{i}", i != 2) for i in range(6)], "compound string, below_corrected_p boolean")
    ap, maps, summary = ev.consistency_of_active(pf, flags, "targets", "compound", null_size=50, min_compounds=2)
    assert {r.row_id for r in ap.collect()} == {i for i in range(60) if i % 6 != 2}
    assert {r.label: r.n_rows for r in maps.collect()} == {"t0": 20, "t1": 30} and summary.first().n_targets_total == 2
    none = flags.withColumn("below_corrected_p", F.col("compound") == "c0")
    assert ev.consistency_of_active(pf, none, "targets", "compound", null_size=50, min_compounds=2)[1].count() == 0


def test_subsamples_are_nested(spark):
    df = spark.createDataFrame([(f"c{i % 50}",) for i in range(200)], "compound string")
    got = {}
    for r in sat.memberships(df, "compound", (0.1, 0.5, 1.0, 0.001), (0, 1)).collect():
        got.setdefault((r.seed, r.fraction), set()).add(r.compound)
    for s in (0, 1):
        assert [len(got[s, f]) for f in (0.001, 0.1, 0.5, 1.0)] == [1, 5, 25, 50]
        assert got[s, 0.001] < got[s, 0.1] < got[s, 0.5] < got[s, 1.0]
    assert got[0, 0.1] != got[1, 0.1]


def brute_plate_effect(rows, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, (_, plate, well, compound) in enumerate(rows):
        steps = [(-np.rint(x[i] @ x[j] / 1e-6), q != plate) for j, (_, q, w, c) in enumerate(rows)
                 if c != compound and (q == plate or w != well)]
        steps.sort()
        hits, total = 0, 0.0
        for k, (_, miss) in enumerate(steps, 1):
            if not miss:
                hits += 1
                total += hits / k
        out[i] = total / hits
    return out


@pytest.mark.parametrize("block", [1024, 24])
def test_plate_effect_over_all_pairs(spark, block):
    """Large tiles (one of 400 rows) and many small ones against every pair."""
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, (i // 3) % 40, int(rng.integers(0, 30))) for i in range(400)]
    x = rng.normal(size=(400, 4))
    df = spark.createDataFrame([(*r, v.tolist()) for r, v in zip(rows, x)], "row_id long, plate long, well long, compound long, features array<double>")
    ap = ev.plate_effect(ProfileFrame(df, tuple("abcd")), "well", "plate", "compound", block=block)
    got, want = {r.row_id: r.average_precision for r in ap.collect()}, brute_plate_effect(rows, x)
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in want)


@pytest.mark.parametrize("held, cells", [(1 << 26, 200_000), (1 << 12, 3), (1, 50)])
def test_p_values_by_slices_of_draws_and_parts_of_groups(spark, held, cells):
    rng = np.random.default_rng(5)
    kinds = [(r, n) for r in (2, 5, 9) for n in (11, 30)]
    table = {k: rng.random(50) for k in kinds}
    nulls = spark.createDataFrame([(*k, v.tolist()) for k, v in table.items()], "n_pos_pairs long, n_total_pairs long, draws array<double>")
    groups, want = [], {}
    for i in range(40):
        made = [kinds[j] for j in sorted(rng.choice(6, size=1 + i % 5, replace=False))] if i % 4 else [kinds[0]]
        cfg, seen = [(*k, int(rng.integers(1, 4)) if i % 4 else 1) for k in made], float(rng.random())
        mean = sum(table[c[:2]] * c[2] for c in cfg) / sum(c[2] for c in cfg)
        groups.append((i, seen, cfg))
        want[i] = (1 + int((mean >= seen).sum())) / 51
    df = spark.createDataFrame(groups, "g int, seen double, cfg array<struct<n_pos_pairs:bigint,n_total_pairs:bigint,weight:bigint>>").repartition(5)
    out = ev.with_p_values(df, "cfg", "seen", nulls, held=held, cells=cells)
    assert out.columns == ["g", "seen", "cfg", "p_value"]
    assert {r.g: r.p_value for r in out.collect()} == pytest.approx(want)
