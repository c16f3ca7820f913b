"""Operators against brute force on small inputs, including the ways that serve groups of any size."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenospark.operators import aggregate as ag
from phenospark.operators import batch as bt
from phenospark.operators import curate as cu
from phenospark.operators import evaluate as ev
from phenospark.operators import linalg as la
from phenospark.operators import masks as mk
from phenospark.operators import normalize as nm
from phenospark.operators import ordered as od
from phenospark.operators import pairs as pr
from phenospark.operators import relational as rel
from phenospark.operators import retrieval as rt
from phenospark.operators import select as sel
from phenospark.operators import stats as st
from phenospark.operators.frame import ProfileFrame
from phenospark.plans import steps


def make_frame(spark, n=60, d=5, seed=0, batches=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 1.0
    rows = [(i, f"b{i % batches}", i % 4 == 0, f"c{i % 6}", x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, batch string, negcon boolean, compound string, features array<double>")
    return ProfileFrame(df, tuple(f"f{j}" for j in range(d))), x


def rows_of(pf):
    got = {r["row_id"]: r["features"] for r in pf.df.collect()}
    return np.array([got[i] for i in sorted(got)])


# ---- quantiles and running sums ------------------------------------------------------------------

@pytest.mark.parametrize("limit", [10**6, 10])
def test_quantiles_exact_for_any_group_size(spark, limit):
    rng = np.random.default_rng(1)
    data = [("hot", float(v)) for v in rng.normal(size=3001)] + [("tied", float(v)) for v in rng.integers(0, 3, 500)]
    data += [("small", 1.0), ("small", 4.0), ("one", 7.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in ag.group_quantiles(df, ["k"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"], group_limit=limit).collect()}
    for k, part in pd.DataFrame(data, columns=["k", "v"]).groupby("k"):
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], part.v.quantile([0.1, 0.5, 0.9]), atol=1e-12)


def test_quantiles_without_keys(spark):
    v = np.random.default_rng(2).normal(size=999)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for limit in (10**6, 5):
        assert np.isclose(ag.group_median(df, [], "v", "m", group_limit=limit).first()["m"], np.median(v))


def test_running_sums_across_partitions(spark):
    rng = np.random.default_rng(3)
    data = [("hot" if i % 3 else f"k{i % 5}", int(rng.integers(0, 40)), i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(5)
    direct = od.running_sums(df, ["k"], ["v", "id"], {"n": F.lit(1), "s": F.col("v")})
    ranged = od.running_sums(df, ["k"], ["v", "id"], {"n": F.lit(1), "s": F.col("v")}, direct_limit=10)
    key = lambda d: sorted((r["k"], r["v"], r["id"], r["n"], r["s"]) for r in d.collect())
    assert key(direct) == key(ranged)


def test_mean_rank_matches_pandas(spark):
    data = [("a", float(v)) for v in [3, 1, 1, 2, 3, 3]] + [("b", 5.0)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)], "k string, v double, id int")
    got = {r["id"]: r["rank"] for r in od.mean_rank(df, ["k"], "v", direct_limit=1).collect()}
    want = pd.DataFrame(data, columns=["k", "v"]).groupby("k").v.rank()
    assert [got[i] for i in range(len(data))] == want.tolist()


# ---- sampling ------------------------------------------------------------------------------------

def test_fraction_sample_sizes_and_stability(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, "hot").otherwise((F.col("id") % 7).cast("string")))
    a = rel.sample_fraction_per_group(df, ["g"], ["id"], 0.1, seed=4)
    b = rel.sample_fraction_per_group(df.repartition(11), ["g"], ["id"], 0.1, seed=4)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    for r in a.groupBy("g").count().collect():
        assert r["count"] == max(1, int(sizes[r["g"]] * 0.1))


def test_nested_subsample_is_nested(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 40).alias("t"), (F.col("id") % 5).alias("plate"), (F.col("id") % 40 == 0).alias("neg"))
    pick = lambda n: {r["t"] for r in rel.nested_subsample(df, "t", F.col("neg"), "plate", n, 9).filter("NOT neg").collect()}
    assert len(pick(5)) == 5 and pick(5) < pick(12)


def test_pairs_in_group_with_blocks(spark):
    df = spark.createDataFrame([(f"t{i % 3}", i) for i in range(60)], "t string, c int")
    one = {tuple(r) for r in rel.pairs_in_group(df, ["t"], "c").collect()}
    many = {tuple(r) for r in rel.pairs_in_group(df, ["t"], "c", block=4).collect()}
    assert one == many == {(a, b) for a in range(60) for b in range(60) if a != b and a % 3 == b % 3}


def test_pairs_sharing_several_groups_come_once(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(12)}", rng.randrange(3), i % 40) for i in range(260)] + [(f"t{t}", k, 99) for t in range(12) for k in range(3)]
    rows += [("t1", 1, i) for i in range(100, 140)] + [(None, 1, 3), ("t1", 1, None), ("lone", 0, 500)] + rows[:20]
    df = spark.createDataFrame(rows, "t string, k int, c int")
    for keys in (["t"], ["t", "k"]):
        groups = {}
        for t, k, c in rows:
            if t is not None and c is not None:
                groups.setdefault((t, k)[:len(keys)], set()).add(c)
        want = sorted({(a, b) for g in groups.values() for a in g for b in g if a != b})
        for kw in ({}, {"block": 4}, {"block": 4, "widest": 3}, {"widest": 1}):
            assert sorted(tuple(r) for r in rel.pairs_in_group(df, keys, "c", **kw).collect()) == want, (keys, kw)


def shared_groups(seed, n=300):
    """(group, kind, member) rows with repeats, NULLs, equal members, a member of all groups, and the pairs by brute force."""
    rng = random.Random(seed)
    rows = [(f"t{rng.randrange(8)}", rng.randrange(2), i % 90) for i in range(n)] + [(f"t{t}", k, 99) for t in range(8) for k in range(2)]
    rows += [("t1", 1, i) for i in range(100, 130)] + [("t2", 0, i) for i in range(120, 140)] + [(None, 1, 3), ("t1", 1, None), ("lone", 0, 500)] + rows[:20]
    groups = {}
    for t, k, c in rows:
        if t is not None and c is not None:
            groups.setdefault((t, k), set()).add(c)
    return rows, {(a, b) for g in groups.values() for a in g for b in g if a != b}


def test_links_of_classes_stand_for_all_pairs(spark):
    rows, want = shared_groups(3)
    df = spark.createDataFrame(rows, "t string, k int, c int")
    for kw in ({}, {"block": 4}, {"block": 4, "widest": 1}):
        links, members = rel.class_pairs_in_group(df, ["t", "k"], "c", **kw)
        of = {}
        for rep, i in members.collect():
            of.setdefault(rep, []).append(i)
        got = [(x, y) for a, b in links.collect() for x in of[a] for y in of[b] if x != y]
        assert len(got) == len(set(got)) and set(got) == want, kw
    alike = spark.createDataFrame([(f"t{i % 3}", i) for i in range(60)], "t string, c int")
    assert rel.class_pairs_in_group(alike, ["t"], "c")[0].count() == 3  # for 1,140 pairs


def test_edge_counts_by_class_are_those_of_the_edges(spark):
    rows, want = shared_groups(4)
    cg = spark.createDataFrame([(str(c) if c is not None else None, t, str(k)) for t, k, c in rows], "compound string, target string, action_class string")
    extra = spark.createDataFrame([("a", "x", "b", "orf", "gg"), (None, None, "b", None, "gg")], "compound string, target string, partner string, target_modality string, source string")
    keys = ["target", "action_class"]
    one = cu.union_edges(extra, cu.bridged_compound_edges(cg, keys))
    classes = cu.union_edges(extra, cu.bridged_compound_classes(cg, keys)[0])
    assert classes.count() < one.count()
    got = {tuple(r) for r in cu.edge_counts(classes).collect()}
    assert got == {tuple(r) for r in cu.edge_counts(one).collect()}
    assert got == {("gg", 2, 1, 1, 1, 1), ("cc", len(want), len({a for a, _ in want}), len({b for _, b in want}), 0, 0)}


def test_coverage_by_class(spark):
    rows, want = shared_groups(5)
    links, members = rel.class_pairs_in_group(spark.createDataFrame(rows, "t string, k int, c int"), ["t", "k"], "c")
    profiles = spark.createDataFrame([(i,) for i in range(0, 140, 3)] * 2, "c int")
    pool = spark.createDataFrame([(i,) for i in range(0, 140, 2)], "c int")
    pairs = spark.createDataFrame(sorted(want), "query int, ref int")
    for p in (None, pool):
        got = rt.coverage(links.toDF("query", "ref"), profiles, "c", p, members=members)
        assert got.first() == rt.coverage(pairs, profiles, "c", p).first()


# ---- selection and normalization -----------------------------------------------------------------

def test_independent_set():
    a = np.zeros((5, 5), dtype=bool)
    for i, j in ((0, 1), (0, 2), (0, 3)):
        a[i, j] = a[j, i] = True
    assert sel.independent_set(a) == {1, 2, 3, 4}


def test_filter_chain_resets_to_all_features(spark):
    pf, _ = make_frame(spark)
    out = sel.filter_features(pf, [("include", {"patterns": ["f1"]}), ("include", {"patterns": ["nothing"]})])
    assert out.names == pf.names


def test_robust_mad_by_controls(spark):
    pf, x = make_frame(spark)
    got = rows_of(nm.robust_mad(pf, ["batch"], F.col("negcon")))
    for b in range(3):
        at = np.arange(60) % 3 == b
        fit = x[at & (np.arange(60) % 4 == 0)]
        med = np.median(fit, 0)
        assert np.allclose(got[at], (x[at] - med) / np.median(np.abs(fit - med), 0))


def test_inverse_normal(spark):
    pf, x = make_frame(spark, n=31, d=2)
    inv = statistics.NormalDist().inv_cdf
    want = np.column_stack([[inv((r - 0.375) / 31.25) for r in x[:, j].argsort().argsort() + 1] for j in range(2)])
    assert np.allclose(rows_of(nm.inverse_normal_transform(pf)), want, atol=1e-12)
    assert np.allclose(rows_of(nm.inverse_normal_transform(pf, direct_limit=5)), want, atol=1e-12)


# ---- linear algebra ------------------------------------------------------------------------------

def test_moments_match_numpy(spark):
    pf, x = make_frame(spark)
    m = la.global_moments(pf)
    assert m.n == 60 and np.allclose(m.cov(), np.cov(x.T)) and np.allclose(m.corr(), np.corrcoef(x.T))


def test_ledoit_wolf_limits():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 8))
    c = x - x.mean(0)
    shrunk = la.ledoit_wolf(c.T @ c, 20, float(((c ** 2).sum(1) ** 2).sum()))
    emp = c.T @ c / 20
    weight = 1 - shrunk[0, 1] / emp[0, 1]
    assert 0 < weight <= 1 and np.isclose(np.trace(shrunk), np.trace(emp))
    assert np.allclose(shrunk, (1 - weight) * emp + weight * np.trace(emp) / 8 * np.eye(8))


@pytest.mark.parametrize("method", ["ZCA", "PCA", "ZCA-cor", "PCA-cor"])
def test_spherize_whitens(spark, method):
    pf, _ = make_frame(spark)
    out = bt.spherize(pf, None, None, method, epsilon=1e-12)
    assert np.allclose(la.global_moments(out).cov(), np.eye(5) * (60 / 60), atol=0.05)


def test_spherize_removes_axes(spark):
    pf, x = make_frame(spark)
    out = bt.spherize(pf, None, None, "ZCA", remove="threshold", variance=0.5)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    k = min(int(np.searchsorted(np.cumsum(s) / s.sum(), 0.5)) + 1, 4)
    assert out.width == 5 - k and out.names[0] == "Spherize_0"


def test_parallel_analysis_finds_strong_axis(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) + np.outer(rng.normal(size=300) * 5, np.ones(6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, features array<double>")
    pf = ProfileFrame(df, tuple("abcdef"))
    assert bt.spherize(pf, None, None, "ZCA-cor", remove="pa", n_permutations=5).width == 5


def test_models_streamed_equal_broadcast(spark):
    pf, x = make_frame(spark)
    fit = lambda m: (m.mean, la.matrix_inv_sqrt(m.cov() + np.eye(5)))
    models = bt.batch_models(pf, "batch", F.col("negcon") & (F.col("batch") != "b1"), fit)
    for missing in ("keep", "zero", "drop"):
        a = la.apply_models(pf, models, "batch", pf.names, missing)
        b = la.apply_models(pf, models, "batch", pf.names, missing, broadcast_bytes=0)
        assert a.df.count() == b.df.count() == (40 if missing == "drop" else 60)
        assert np.allclose(rows_of(a), rows_of(b))


def test_coral_aligns_controls(spark):
    pf, x = make_frame(spark, n=120)
    neg = F.col("negcon")
    out = bt.coral(pf, "batch", neg, epsilon=1e-9)
    one = la.global_moments(out, neg & (F.col("batch") == "b2")).cov()
    assert np.allclose(one, la.global_moments(pf, neg).cov(), atol=1e-5)


def test_few_controls_give_zero_rows(spark):
    pf, _ = make_frame(spark, n=120)
    neg = F.col("negcon") & (F.col("batch") != "b0")
    out = bt.tvn_original(pf, "batch", neg, k=3)
    zero = out.df.filter("batch = 'b0'").select(F.max(F.array_max(F.transform("features", F.abs)))).first()[0]
    assert zero == 0.0 and out.names == ("TVN_0", "TVN_1", "TVN_2")


def test_component_clamp():
    assert bt.clamp_components(100, 50) == 100 and bt.clamp_components(100, 20) == 19
    with pytest.raises(ValueError):
        bt.clamp_components(100, 20, action="abort")


# ---- retrieval and average precision ---------------------------------------------------------------

def brute_ap(sim, pos, neg):
    out = {}
    for i in range(len(sim)):
        p, n = np.flatnonzero(pos[i]), np.flatnonzero(neg[i])
        if not len(p):
            continue
        cand = sorted([(-sim[i, j], 0) for j in p] + [(-sim[i, j], 1) for j in n])
        hits = [r + 1 for r, (_, kind) in enumerate(cand) if kind == 0]
        out[i] = (len(p), len(cand), float(np.mean([(k + 1) / r for k, r in enumerate(hits)])))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_average_precision_matches_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    n = 90
    x = rng.normal(size=(n, 4))
    comp = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 8, n)) if hot else rng.integers(0, 12, n)
    plate, neg = rng.integers(0, 4, n), rng.random(n) < 0.3
    rows = [(i, int(comp[i]), int(plate[i]), bool(neg[i]), x[i].tolist()) for i in range(n)]
    pf = ProfileFrame(spark.createDataFrame(rows, "row_id bigint, comp bigint, plate bigint, neg boolean, features array<double>"), tuple("abcd"))
    got = ev.average_precision(pf, ev.PairRule(("comp",), (), ~F.col("neg")), ev.PairRule(("plate",), ("comp",), F.col("neg")),
                               query=~F.col("neg"), block=7)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.rint(u @ u.T / pr.RESOLUTION)
    same = lambda v: v[:, None] == v[None, :]
    q = ~neg[:, None]
    pos = q & same(comp) & ~neg[None, :] & ~np.eye(n, dtype=bool)
    negm = q & same(plate) & neg[None, :] & ~same(comp)
    want = brute_ap(sim, pos, negm)
    rows = {r["row_id"]: (r["n_pos_pairs"], r["n_total_pairs"], r["average_precision"]) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k in want:
        assert rows[k][:2] == want[k][:2] and np.isclose(rows[k][2], want[k][2], atol=1e-12)


def test_expected_precision_is_the_mean_over_placements(spark):
    from itertools import combinations

    df = spark.createDataFrame([(r, n) for n in range(1, 8) for r in range(1, n + 1)], "r bigint, n bigint")
    for row in df.withColumn("e", ev.expected_precision(F.col("r"), F.col("n"))).collect():
        aps = [np.mean([(i + 1) / (p + 1) for i, p in enumerate(c)]) for c in combinations(range(row["n"]), row["r"])]
        assert np.isclose(row["e"], np.mean(aps))


def test_random_precisions_repeat_and_centre():
    a = ev.random_precisions(3, 20, 4000, 1)
    assert np.array_equal(a, ev.random_precisions(3, 20, 4000, 1)) and a.max() <= 1.0
    h = sum(1 / i for i in range(1, 21))
    assert abs(a.mean() - (h + (20 - h) * 2 / 19) / 20) < 0.01


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.04, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_value double")
    got = [r["corrected_p_value"] for r in ev.benjamini_hochberg(df).orderBy("i").collect()]
    order = np.argsort(p)
    adj = np.minimum.accumulate((np.array(p)[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    want = np.empty(6)
    want[order] = np.minimum(adj, 1)
    assert np.allclose(got, want)


def test_perfect_replicates_are_significant(spark):
    rows = []
    for c in range(8):
        for k in range(4):
            v = np.zeros(8)
            v[c] = 1.0
            rows.append((len(rows), c, 0, False, (v + 0.01 * k).tolist()))
    rng = np.random.default_rng(8)
    rows += [(len(rows) + i, 100 + i, 0, True, rng.normal(size=8).tolist()) for i in range(40)]
    pf = ProfileFrame(spark.createDataFrame(rows, "row_id bigint, compound bigint, plate bigint, neg boolean, features array<double>"), tuple("abcdefgh"))
    ap, maps = ev.phenotypic_activity(pf, "compound", "neg", "plate", null_size=500)
    assert ap.filter("average_precision < 1").count() == 0
    assert maps.filter("below_corrected_p").count() == 8
    assert ev.row_p_values(ap, 200).agg(F.max("p_value")).first()[0] < 0.05


def test_recall_grows_with_k(spark):
    pf, _ = make_frame(spark, n=80, d=6)
    edges = pf.df.select(F.col("row_id").alias("query"), "compound").join(pf.df.select(F.col("row_id").alias("ref"), "compound"), "compound")
    edges = edges.filter("query <> ref").select("query", "ref")
    for direction in ("top", "bottom"):
        r = rt.recall_at_k(rt.compound_retrieval(pf, edges, "row_id", "batch", direction=direction, block=9))
        for row in r.collect():
            assert row["recall_1"] <= row["recall_5"] <= row["recall_10"]


# ---- statistics and masks --------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [10**6, 3])
def test_distribution_distances(spark, limit):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=50), rng.normal(1, 2, size=40)
    df = spark.createDataFrame([("f", float(v), True) for v in a] + [("f", float(v), False) for v in b], "f string, v double, is_a boolean")
    got = st.distribution_distances(df, ["f"], "v", "is_a", direct_limit=limit).first()
    grid = np.sort(np.r_[a, b])
    fa, fb = np.searchsorted(np.sort(a), grid, "right") / 50, np.searchsorted(np.sort(b), grid, "right") / 40
    assert np.isclose(got["ks"], np.abs(fa - fb).max())
    assert np.isclose(got["wasserstein"], (np.abs(fa - fb)[:-1] * np.diff(grid)).sum())


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([("f", 1.0, float(i)) for i in range(5)], "k string, a double, b double")
    assert st.feature_correlations(df, ["k"]).first()["r"] is None


def test_shifted_square_has_no_match(spark):
    """A 10 x 10 square against itself shifted by five: one miss on either side."""
    px = [(0, y, x, int(y < 10 and x < 10), int(5 <= y < 15 and 5 <= x < 15)) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(px, "site int, y int, x int, gt_id bigint, pred_id bigint")
    for r in mk.instance_scores(mk.contingency(df, ["site"]), ["site"]).collect():
        assert (r["tp"], r["fp"], r["fn"]) == (0, 1, 1)


def test_tie_at_one_half_matches_once(spark):
    """One object cut into two equal halves: both overlap it by exactly one half, one of them can match."""
    df = spark.createDataFrame([(0, i, 1, 1 if i < 8 else 2) for i in range(16)], "site int, x int, gt_id bigint, pred_id bigint")
    r = mk.instance_scores(mk.contingency(df, ["site"]), ["site"], [0.5]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0)


def test_digest_ignores_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    a, b = (ag.set_digest(d, F.col("k")).first() for d in (df, df.orderBy(F.rand(1)).repartition(7)))
    assert a == b and a != ag.set_digest(df.filter("k <> '7'"), F.col("k")).first()


# ---- step plans --------------------------------------------------------------------------------------

def test_preset_runs_end_to_end(spark):
    rng = np.random.default_rng(10)
    n = 160
    x = rng.normal(size=(n, 12))
    rows = [(i, f"p{i % 4}", f"w{i % 20}", "negcon" if i % 4 == (i // 4) % 4 else "trt", x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, Metadata_Plate string, Metadata_Well string, Metadata_control_type string, features array<double>")
    pf = ProfileFrame(df, tuple(f"f{j}" for j in range(12)))
    cfg = {"norm_method": "standardize", "batch_method": "tvn_efaar", "use_int": True, "use_wellcorr": True,
           "use_sample_norm": True, "tvn_efaar_n_components": 4, "pca_n_components": 6}
    plan = steps.configure(steps.PRESETS["full"], cfg)
    out = steps.run(pf, plan, validate=True, checkpoints=["prune_correlated"])
    assert out.df.count() == n and out.names == ("PC_0", "PC_1", "PC_2", "PC_3")
    assert steps.output_name(plan) == "std_ctrl__outlier500__INT__wellcorr__snorm_l2__prune0.9__tvn_efaar_e0.5_c4"


def test_registered_step(spark):
    pf, x = make_frame(spark)
    steps.register("double", lambda f, p: f.map_features(lambda v: F.transform(v, lambda e: e * p["by"])))
    assert np.allclose(rows_of(steps.run(pf, [steps.Step("double", {"by": 2.0})])), 2 * x)


def test_redundant_configs():
    assert steps.redundant({"batch_method": "none", "tvn_efaar_epsilon": 1.0})
    assert steps.redundant({"batch_method": "tvn_efaar", "use_spherize": True})
    assert steps.redundant({"batch_method": "tvn_efaar", "tvn_efaar_epsilon": 1.0}) is None


def test_bad_relation_type_fails(spark):
    from phenospark.operators.curate import classify_actions

    df = spark.createDataFrame([("a", "t", "no such type")], "compound string, target string, rel_type string")
    with pytest.raises(Exception, match="without action class"):
        classify_actions(df).collect()


def test_independent_set_rule():
    rng = np.random.default_rng(0)
    for n in (1, 5, 30):
        linked = np.triu(rng.random((n, n)) < 0.2, 1)
        linked |= linked.T
        left, want = set(range(n)), set()
        while left:
            node = min(left, key=lambda i: (sum(linked[i, j] for j in left), i))
            want.add(node)
            left -= {j for j in left if linked[node, j]} | {node}
        assert sel.independent_set(linked) == want


def test_layout_looks_at_all_objects(spark):
    from phenospark.sources import io

    rows = [(f"o{i}", "m", 1.0) for i in range(60)] + [("cell", "m", 1.0)]
    assert io.sample_layout(spark.createDataFrame(rows, "object string, metric string, value double"))[0] == "cp_long"


def test_settings_reach_their_step():
    plain = steps.configure(steps.PRESETS["full"], {"batch_method": "spherize_global"})
    for more in ({"spherize_remove_variance_method": "pa"}, {"spherize_remove_variance_threshold": 0.9}, {"spherize_remove_variance_method": "pa", "spherize_n_permutations": 3}):
        got = steps.configure(steps.PRESETS["full"], {"batch_method": "spherize_global", **more})
        assert steps.output_name(got) != steps.output_name(plain)
    off = steps.configure(steps.PRESETS["full"], {"use_filter_features": False})
    assert not any(s.enabled for s in off if s.name == "filter_features")
    with pytest.raises(ValueError, match="nonsense"):
        steps.configure(steps.PRESETS["full"], {"nonsense": 1})


def test_thin_groups_are_left_out(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{g}{p}{w}", g, f"{g}p{p}", w, f"c{(3 * p + w) % 7}", rng.standard_normal(4).tolist()) for g, n in (("one", 1), ("two", 3)) for p in range(n) for w in range(6)]
    df = spark.createDataFrame(rows, "row_id string, grp string, plate string, well int, compound string, features array<double>")
    pf = ProfileFrame(df, ["a", "b", "c", "d"], "row_id")
    got = ev.plate_effect(pf, "well", "plate", "compound", "grp").select("row_id").collect()
    assert got and all(r.row_id.startswith("two") for r in got)
    small = pf.with_df(df.limit(5))
    assert ev.plate_effect(small, "well", "plate", "compound", "grp").count() == 0


def test_moments_by_keys_of_any_type(spark):
    """Date, decimal, double and NULL keys; every key's matrix against numpy."""
    import datetime as dt
    from decimal import Decimal

    rng = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    rows = [(days[i % 3], Decimal(i % 2), float(i % 2), rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "day date, price decimal(10,2), level double, features array<double>").repartition(5)
    pf = ProfileFrame(df, ("a", "b", "c", "d"))
    found = la.moment_table(pf, ["day", "price", "level"], shift=np.zeros(4)).collect()
    assert len(found) == 6
    for r in found:
        x = np.array([f for day, price, level, f in rows if (day, price, level) == (r.day, r.price, r.level)])
        m = np.asarray(r.moments).reshape(4, 6)
        assert np.allclose(m[:, :4], x.T @ x) and np.allclose(m[:, 4], x.sum(0)) and (m[:, 5] == len(x)).all()


def test_large_groups_are_not_sorted_for_their_quantiles(spark):
    """The rows of a large group must not meet in one task: its bounds travel to them."""
    df = spark.createDataFrame([(i % 3, float(i * 7 % 101)) for i in range(300)], "k int, v double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ag.group_median(df, ["k"], "v", group_limit=10)
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString()
        got = dict(out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {k: statistics.median(float(i * 7 % 101) for i in range(300) if i % 3 == k) for k in range(3)}


def test_rank_operators_read_their_input_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"row_id": range(60), "k": [i % 2 for i in range(60)], "a": rng.integers(0, 9, 60) * 1.0, "b": rng.normal(size=60)})
    path = str(tmp_path / "rows")
    spark.createDataFrame(x).write.parquet(path)
    df = spark.read.parquet(path)
    rho = st.spearman(df, ["k"])
    assert not any(path in f for f in rho.inputFiles())
    got = {r["k"]: (round(r["rho"], 9), r["n"]) for r in rho.collect()}
    assert got == {k: (round(g["a"].rank().corr(g["b"].rank()), 9), len(g)) for k, g in x.groupby("k")}
    scored = nm.inverse_normal_transform(ProfileFrame.from_wide(df, ["a", "b"]))
    assert not any(path in f for f in scored.df.inputFiles())
    assert scored.df.count() == 60


def test_annotations_are_grouped_before_they_meet_the_ids(spark, tmp_path):
    """Below the aggregates the raw rows would be sorted by id, and one task would hold the sort and every aggregate."""
    raw = spark.createDataFrame([("x", 1, 5), ("x", 1, 6), ("y", 2, 5), ("y", 2, 7), ("z", 3, 5), ("w", None, 1)], "target string, compound int, line int")
    ann = raw.groupBy("target", "compound", "line").agg(F.count("*").alias("support")).select("target", "compound", "support")
    ids, extra = (spark.createDataFrame([(i,) for i in rows], "compound int") for rows in ([1, 1, 2, None], [2, 3]))
    ids.write.parquet(str(tmp_path / "ids"))  # small enough to be broadcast, by its files
    out = cu.annotation_overlap(ann, spark.read.parquet(str(tmp_path / "ids")), "compound", extra, "compound", "listed")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan[plan.index("count(1)"):]
    assert sorted((r.compound, r.target, r.support, r.listed) for r in out.collect()) == [(1, "x", 1, False), (2, "y", 1, True)]


def test_site_medians_take_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i % 2}", "f", None if i % 17 == 0 else i % 5, None if i % 7 == 0 else float(rng.integers(0, 20)), float(rng.normal())) for i in range(400)]
    x = pd.DataFrame(rows, columns=["codec", "feature", "site", "a", "b"])
    df = spark.createDataFrame(rows, "codec string, feature string, site int, a double, b double")
    keys = ["codec", "feature", "site"]
    want = {k: tuple(np.round(v, 9)) for k, v in zip(*(lambda g: (g.index, g[["a", "b"]].values))(x.dropna(subset=["site"]).groupby(keys).median()))}
    out = st.site_level(df, keys, "a", "b")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for got in (out, ag.group_medians(df.dropna(subset=["site"]), keys, ["a", "b"], group_limit=10)):
        assert {(r.codec, r.feature, r.site): (round(r.a, 9), round(r.b, 9)) for r in got.collect()} == want


def test_many_small_models_take_no_step_per_key(spark):
    """Rows of keys with a small model keep their order in the batch; the others follow, key by key."""
    rng = np.random.default_rng(9)
    x, mu, m = rng.normal(size=(300, 3)), rng.normal(size=(40, 3)), rng.normal(size=(40, 3, 3))
    keys = [None if i % 50 == 7 else f"b{(i * 7) % 41}" for i in range(300)]  # b40 has no model
    df = spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, x))], "row_id int, batch string, features array<double>").coalesce(1)
    models = spark.createDataFrame([(f"b{i}", mu[i].tolist(), m[i].ravel().tolist()) for i in range(40)], "batch string, mu array<double>, m array<double>")
    pf = ProfileFrame(df, ("a", "b", "c"))
    got = la.apply_models(pf, models, "batch", pf.names).df.collect()
    known = [i for i, k in enumerate(keys) if k not in (None, "b40")]
    assert [r.row_id for r in got][:len(known)] == known and sorted(r.row_id for r in got) == list(range(300))
    for r in got:
        j = None if keys[r.row_id] in (None, "b40") else int(keys[r.row_id][1:])
        assert np.allclose(r.features, x[r.row_id] if j is None else (x[r.row_id] - mu[j]) @ m[j])
    dropped = la.apply_models(pf, models, "batch", pf.names, "drop", width_col="w").df.collect()
    assert sorted(r.row_id for r in dropped) == known and {r.w for r in dropped} == {3}


def test_hits_are_not_looked_up_one_by_one(spark):
    """Several labels of a row share its thresholds: their counts are found by order, missing ones are zero."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(20):
        steps = np.sort(rng.choice(60, 30, replace=False))
        hits = np.sort(rng.choice(60, 12, replace=False))
        rows.append((i, [(int(s), int(rng.integers(1, 4))) for s in hits], [(int(s), int(rng.integers(0, 9))) for s in steps] if i else []))
    df = spark.createDataFrame(rows, "id int, hits array<struct<step:bigint,n:bigint>>, above array<struct<step:bigint,above:bigint>>")
    both = df.withColumn("both", ev._hits_behind_thresholds(F.col("hits"), F.col("above")))
    got = {r.id: [tuple(x) for x in r.found] for r in both.select("id", ev._placed_hits(F.col("both")).alias("found")).collect()}
    assert got == {i: [(n, dict(above).get(s, 0)) for s, n in hits] for i, hits, above in rows}
    vectors = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], rng.normal(size=3).tolist()) for i in range(8)], "row_id int, targets array<string>, features array<double>")
    ap = ev.multilabel_precision(ProfileFrame(vectors, ("x", "y", "z")), "targets")
    assert "map_from_entries" not in ap._jdf.queryExecution().optimizedPlan().toString()
