"""Moments, whitening and batch alignment.

Eigenvectors have no unique sign or order, so queries report what does not depend on them: covariances, norms and
moments of the transformed rows.
"""

import numpy as np
from pyspark.sql import functions as F

from phenospark.catalog.base import query, r6
from phenospark.operators import axes as ax
from phenospark.operators import batch as bt
from phenospark.operators import linalg as la
from phenospark.operators import normalize as nm
from phenospark.operators.frame import ProfileFrame

NAMES = tuple(f"e{i}" for i in range(64))
FEATS = ["f0", "f1", "f2", "f3"]
CONTROL = "negcon"


def vectors(t) -> ProfileFrame:
    return ProfileFrame(t.vectors, NAMES)


def normalized(t) -> ProfileFrame:
    from phenospark.session import materialize

    pf = nm.standardize(ProfileFrame.from_wide(t.profiles, FEATS), ["plate"], F.col(CONTROL))
    return pf.with_df(materialize(pf.df.withColumn("plate", F.col("plate").cast("string")), "norm"))


def matrix_rows(t, m, names, digits=6):
    rows = [(names[i], names[j], round(float(m[i, j]), digits) + 0.0) for i in range(len(m)) for j in range(m.shape[1])]
    return t.spark.createDataFrame(rows, "a string, b string, value double")


def shape_report(pf: ProfileFrame, keys=("batch",)):
    """Per batch: rows, width, mean squared norm and mean of the first two feature means (sign free)."""
    sq = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return pf.df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), r6(F.avg(sq), 4).alias("mean_sq_norm"))


X_SQL = "x AS (SELECT vec_id, vec_id % 8 AS batch, vec_id % 5 = 0 AS negcon, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)"


@query("lin_01_covariance", f"""WITH {X_SQL} SELECT 'e' || p.i AS a, 'e' || q.i AS b, round(covar_samp(p.v, q.v), 6) AS value, round(corr(p.v, q.v), 6) AS r
  FROM x p JOIN x q USING (vec_id) GROUP BY p.i, q.i""")
def _(t):
    m = la.global_moments(vectors(t))
    cov, cor = matrix_rows(t, m.cov(), NAMES), matrix_rows(t, m.corr(), NAMES).withColumnRenamed("value", "r")
    return cov.join(cor, ["a", "b"])


@query("lin_01_covariance_by_batch", """WITH {profiles}, {plong} SELECT CAST(plate AS VARCHAR) AS plate, n, round(cov01, 4) AS cov01, round(cov23, 8) AS cov23 FROM (
   SELECT plate, count(*) AS n, covar_samp(f0, f1) AS cov01, covar_samp(f2, f3) AS cov23 FROM profiles GROUP BY plate)""")
def _(t):
    pf = ProfileFrame.from_wide(t.profiles.withColumn("plate", F.col("plate").cast("string")), FEATS)
    shift = la.column_means(pf)
    table = la.moment_table(pf, ["plate"], None, shift)
    n = F.col("moments")[5]
    cell = lambda i, j: (F.col("moments")[6 * i + j] - F.col("moments")[6 * i + 4] * F.col("moments")[6 * j + 4] / n) / (n - 1)
    return table.select("plate", n.cast("bigint").alias("n"), r6(cell(0, 1), 4).alias("cov01"), r6(cell(2, 3), 8).alias("cov23"))


@query("lin_02_matrix_powers", f"""WITH {X_SQL} SELECT 'e' || p.i AS a, 'e' || q.i AS b, round(covar_samp(p.v, q.v), 6) AS value FROM x p JOIN x q USING (vec_id) GROUP BY p.i, q.i""")
def _(t):
    """The square of the square root, and the inverse of the squared inverse root, are the matrix again."""
    c = la.global_moments(vectors(t)).cov()
    again = la.matrix_sqrt(c) @ la.matrix_power(la.matrix_inv_sqrt(c), -1) @ np.eye(len(c))
    return matrix_rows(t, (again + again.T) / 2, NAMES)


@query("lin_03_condition_number")
def _(t):
    return bt.whitening_report(vectors(t), "batch", F.col(CONTROL)).select("batch", "n_controls", "ill_conditioned")


@query("lin_04_whitening_matrices", f"""SELECT i AS a, j AS b, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS svd, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS zca,
   CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS inv FROM range(64) x(i), range(64) y(j)""")
def _(t):
    """Covariance after either whitening, and inverse times matrix, are the identity."""
    m = la.global_moments(vectors(t))
    c = m.cov()
    w, _ = la.svd_whitening(m)
    z = la.zca_whitening(m)
    svd, zca, inv = w.T @ c @ w, z.T @ c @ z, la.regularized_inverse(c, 0.0) @ c
    rows = [(i, j, *[abs(round(float(x[i, j]), 4)) for x in (svd, zca, inv)]) for i in range(64) for j in range(64)]
    return t.spark.createDataFrame(rows, "a bigint, b bigint, svd double, zca double, inv double")


@query("lin_05_ledoit_wolf")
def _(t):
    """Shrunk control covariance per batch: trace is kept, the condition number falls."""
    pf = vectors(t)
    d = pf.width
    centre = bt.batch_models(pf, "batch", F.col(CONTROL), lambda m: (m.mean, np.eye(d)))
    fourth = bt._fourth_moments(pf, centre, "batch", F.col(CONTROL), pf.names)

    def fit(m, row):
        shrunk = la.ledoit_wolf(m.scatter, m.n, row.fourth)
        return np.array([np.trace(shrunk), np.trace(m.scatter / m.n)]), np.array([la.condition_number(shrunk)])

    models = bt.batch_models(pf, "batch", F.col(CONTROL), fit, extra=fourth)
    return models.select("batch", r6(F.col("mu")[0]).alias("trace"), r6(F.col("mu")[1]).alias("sample_trace"), (F.col("m")[0] < 1e6).alias("usable"))


@query("lin_06_pca_whitening", "SELECT count(*) AS n, 10 AS width, 10.0 AS total_variance FROM embeddings")
def _(t):
    pf = vectors(t)
    m = la.global_moments(pf)
    out = la.apply_matrix(pf, m.mean, la.pca_whitening(m, 10), [f"W{i}" for i in range(10)])
    v = la.global_moments(out)
    return out.df.agg(F.count("*").alias("n")).select("n", F.lit(out.width).alias("width"), F.lit(round(float(np.trace(v.cov())), 6)).alias("total_variance"))


@query("lin_07_pca_variance_share", f"""WITH {X_SQL}, t AS (SELECT sum(vs) AS total FROM (SELECT var_samp(v) AS vs FROM x GROUP BY i))
  SELECT round(total, 6) AS total_variance, true AS reaches, true AS minimal FROM t""")
def _(t):
    m = la.global_moments(vectors(t))
    axes, ratio = la.pca_components(m, 0.9)
    _, full = la.pca_components(m, 64)
    k = axes.shape[1]
    row = (round(float(np.trace(m.cov())), 6), bool(full[:k].sum() >= 0.9), bool(full[:k - 1].sum() < 0.9))
    return t.spark.createDataFrame([row], "total_variance double, reaches boolean, minimal boolean")


@query("lin_08_pca_on_controls", f"""WITH {X_SQL}, c AS (SELECT i, avg(v) AS m FROM x WHERE negcon GROUP BY i)
  SELECT vec_id AS row_id, round(sum((v - m) * (v - m)), 4) AS sq_norm FROM x JOIN c USING (i) GROUP BY vec_id""")
def _(t):
    """With all axes kept the projection only turns the rows: distances to the control mean stay."""
    pf = vectors(t)
    m = la.global_moments(pf, F.col(CONTROL))
    axes, _ = la.pca_components(m, 64)
    out = la.apply_matrix(pf, m.mean, axes, [f"PC_{i + 1}" for i in range(64)])
    return out.df.select("row_id", r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 4).alias("sq_norm"))


# ---- wide tables: 1,024 features that follow from few, so that SQL knows the answer --------------------

WIDTH = 1024


def wide(t, base: int) -> ProfileFrame:
    """Feature j is component j mod ``base`` of the vector times (1 + j mod 7) / 4."""
    column = lambda j: F.get(F.col("features"), j % base) * (1 + j % 7) / 4
    df = t.vectors.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), column))
    return ProfileFrame(df, tuple(f"w{j}" for j in range(WIDTH)))


def square_sum(features="features"):
    return F.aggregate(features, F.lit(0.0), lambda a, x: a + x * x)


#: Two components a, b; their covariance; the weights p, q of each over its 512 features.
WIDE2_SQL = """x AS (SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
  m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab FROM x),
  wt AS (SELECT sum(CASE WHEN j % 2 = 0 THEN w * w ELSE 0 END) AS p, sum(CASE WHEN j % 2 = 1 THEN w * w ELSE 0 END) AS q
    FROM (SELECT j, (1 + j % 7) / 4.0::DOUBLE AS w FROM range(1024) r(j)))"""
MAHALANOBIS_SQL = f"""WITH {WIDE2_SQL} SELECT row_id, round((bb * (a - ma) * (a - ma) - 2 * ab * (a - ma) * (b - mb) + aa * (b - mb) * (b - mb)) / (aa * bb - ab * ab), 4) AS sq_norm
  FROM x, m"""


@query("lin_06_wide_whitening", MAHALANOBIS_SQL)
def _(t):
    """Both axes there are, scaled to unit variance: a row's squared norm is its Mahalanobis distance."""
    pf = wide(t, 2)
    found = ax.principal_axes(pf, 2)
    out = la.apply_matrix(pf, found.mean, found.whitening(), ["W0", "W1"])
    return out.df.select("row_id", r6(square_sum(), 4).alias("sq_norm"))


@query("lin_07_wide_variance_share", f"""WITH {WIDE2_SQL}, e AS (SELECT p * aa + q * bb AS total, sqrt(power(p * aa - q * bb, 2) + 4 * p * q * ab * ab) AS gap FROM m, wt)
  SELECT CAST(component AS BIGINT) AS component, round(total, 4) AS total_variance, round((total + sign * gap) / 2 / total, 6) AS share FROM e, (VALUES (1, 1), (2, -1)) v(component, sign)""")
def _(t):
    found = ax.principal_axes(wide(t, 2), 1.0 - 1e-9)
    rows = [(i + 1, round(float(found.total), 4), round(float(r), 6)) for i, r in enumerate(found.ratio)]
    return t.spark.createDataFrame(rows, "component bigint, total_variance double, share double")


@query("lin_08_wide_projection", """WITH x AS (SELECT vec_id, unnest(range(16)) AS i, unnest(CAST(embedding[1:16] AS DOUBLE[])) AS v FROM embeddings), c AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
   wt AS (SELECT j % 16 AS i, sum(power((1 + j % 7) / 4.0::DOUBLE, 2)) AS w FROM range(1024) r(j) GROUP BY j % 16)
  SELECT vec_id AS row_id, round(sum(w * (v - m) * (v - m)), 3) AS sq_norm FROM x JOIN c USING (i) JOIN wt USING (i) GROUP BY vec_id""")
def _(t):
    """The 16 leading axes hold all of rows that follow from 16 components: distances to the mean stay."""
    pf = wide(t, 16)
    found = ax.principal_axes(pf, 16)
    out = la.apply_matrix(pf, found.mean, found.axes, [f"PC_{i}" for i in range(16)])
    return out.df.select("row_id", r6(square_sum(), 3).alias("sq_norm"))


@query("wht_01_wide_spherize", MAHALANOBIS_SQL)
def _(t):
    out = bt.spherize(wide(t, 2), None, None, "ZCA")
    return out.df.select("row_id", r6(square_sum(), 4).alias("sq_norm"))


# ---- axis removal on two correlated features: axes (1, 1) and (1, -1) of the standardized pair ------------

PAIR = ["a", "b"]


def pairs(t, always: bool = True) -> ProfileFrame:
    """f0 with a noisy copy of itself (unless ``always``, on even plates only: elsewhere with the noise), batches of plates."""
    noise = 100 * F.col("f2")
    other = F.col("f0") + noise if always else F.when(F.col("plate") % 2 == 0, F.col("f0") + noise).otherwise(noise)
    rows = t.profiles.select("row_id", (F.col("plate") % 8).cast("string").alias("batch"), F.col("f0").alias("a"), other.alias("b"))
    return ProfileFrame.from_wide(rows, PAIR)


REMOVED_SQL = """WITH {profiles}, x AS (SELECT row_id, f0 AS a, f0 + 100 * f2 AS b FROM profiles),
  z AS (SELECT row_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM x)
  SELECT row_id, CAST(1 AS BIGINT) AS width, round((a - b) * (a - b) / 2, 4) AS sq_norm FROM z"""


def removed(out):
    return out.df.select("row_id", F.lit(out.width).cast("bigint").alias("width"), r6(square_sum(), 4).alias("sq_norm"))


@query("wht_02_variance_removal_values", REMOVED_SQL)
def _(t):
    return removed(bt.spherize(pairs(t), None, None, "ZCA-cor", remove="threshold", variance=0.5))


@query("wht_03_noise_edge_removal_values", REMOVED_SQL)
def _(t):
    return removed(bt.spherize(pairs(t), None, None, "ZCA-cor", remove="mp"))


@query("wht_04_parallel_removal_values", REMOVED_SQL)
def _(t):
    return removed(bt.spherize(pairs(t), None, None, "ZCA-cor", remove="pa", n_permutations=5))


@query("wht_05_removal_per_batch", """WITH {profiles}, x AS (SELECT CAST(plate % 8 AS VARCHAR) AS batch, f0 AS a, 100 * f2 + CASE WHEN plate % 2 = 0 THEN f0 ELSE 0 END AS b FROM profiles),
   m AS (SELECT batch, count(*) AS n, abs(corr(a, b)) AS r FROM x GROUP BY batch),
   k AS (SELECT *, CASE WHEN (1 + r) * n / (n - 1) > power(1 + sqrt(2.0::DOUBLE / n), 2) THEN 1 ELSE 0 END AS k FROM m)
  SELECT batch, n, CAST(2 - k AS BIGINT) AS n_kept, CASE WHEN k = 1 THEN round(1 - r, 4) ELSE round(2 * (n - 1) / n::DOUBLE, 4) END AS mean_sq_norm FROM k""")
def _(t):
    """Each batch loses the axes above its own noise edge: one where the pair is correlated, none elsewhere."""
    out = bt.spherize(pairs(t, False), "batch", None, "ZCA-cor", remove="mp")
    sq = square_sum(F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))))
    return out.df.groupBy("batch").agg(F.count("*").alias("n"), F.max("n_kept").cast("bigint").alias("n_kept"), r6(F.avg(sq), 4).alias("mean_sq_norm"))


IDENTITY4 = "SELECT 'f' || i AS a, 'f' || j AS b, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS value FROM range(4) x(i), range(4) y(j)"


@query("wht_01_spherize", IDENTITY4)
def _(t):
    """Control covariance after whitening on controls is the identity."""
    out = bt.spherize(normalized(t), None, F.col(CONTROL), "ZCA-cor", epsilon=1e-9)
    return matrix_rows(t, np.abs(la.global_moments(out, F.col(CONTROL)).cov()), FEATS, 4)


@query("wht_02_variance_removal")
def _(t):
    out = bt.spherize(vectors(t), None, None, "ZCA-cor", remove="threshold", variance=0.3)
    return shape_report(out)


@query("wht_03_noise_edge_removal")
def _(t):
    return shape_report(bt.spherize(vectors(t), None, None, "ZCA-cor", remove="mp"))


@query("wht_04_parallel_removal")
def _(t):
    return shape_report(bt.spherize(vectors(t), None, None, "ZCA-cor", remove="pa", n_permutations=5))


@query("wht_05_spherize_per_batch", """WITH {profiles} SELECT CAST(plate AS VARCHAR) AS plate, count(*) AS n, 4.0 AS control_trace FROM profiles WHERE negcon GROUP BY plate""")
def _(t):
    out = bt.spherize(normalized(t), "plate", F.col(CONTROL), "PCA-cor", epsilon=1e-9)
    long = out.with_df(out.df.filter(CONTROL)).long("plate")
    per = long.groupBy("plate", "idx").agg(F.var_samp("value").alias("v"), F.count("*").alias("n"))
    return per.groupBy("plate").agg(F.max("n").alias("n"), r6(F.sum("v"), 4).alias("control_trace"))


@query("wht_06_tvn", """WITH {profiles} SELECT CAST(plate AS VARCHAR) AS plate, count(*) AS n, 0.0 AS control_mean FROM profiles WHERE negcon GROUP BY plate""")
def _(t):
    out = bt.tvn(normalized(t), "plate", F.col(CONTROL))
    long = out.with_df(out.df.filter(CONTROL)).long("plate")
    per = long.groupBy("plate", "idx").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return per.groupBy("plate").agg(F.max("n").alias("n"), F.abs(r6(F.sum("m"), 6)).alias("control_mean"))


PLATE_Z = ("st AS (SELECT plate, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-18 AS d_{c}" for c in FEATS)
           + " FROM profiles WHERE negcon GROUP BY plate), z AS (SELECT row_id, plate, " + ", ".join(f"({c} - m_{c}) / d_{c} AS {c}" for c in FEATS)
           + " FROM profiles JOIN st USING (plate) WHERE negcon)")


@query("wht_07_coral", f"""WITH {{profiles}}, {PLATE_Z}, x AS (UNPIVOT z ON {", ".join(FEATS)} INTO NAME f VALUE v),
   target AS (SELECT p.f AS a, q.f AS b, round(covar_samp(p.v, q.v), 4) AS value FROM x p JOIN x q USING (row_id) WHERE p.f <= q.f GROUP BY ALL)
  SELECT CAST(plate AS VARCHAR) AS plate, a, b, value FROM (SELECT plate FROM profiles WHERE negcon GROUP BY plate), target""")
def _(t):
    """After the alignment the controls of every plate have the covariance of all controls."""
    out = bt.coral(normalized(t), "plate", F.col(CONTROL), 1e-9)
    rows = out.df.filter(CONTROL)
    cell = [F.struct(F.lit(FEATS[i]).alias("a"), F.lit(FEATS[j]).alias("b"), r6(F.covar_samp(F.col("features")[i], F.col("features")[j]), 4).alias("value"))
            for i in range(4) for j in range(i, 4)]
    return rows.groupBy("plate").agg(F.array(*cell).alias("c")).select("plate", F.inline("c"))


@query("wht_08_tvn_aligned")
def _(t):
    return shape_report(bt.tvn_aligned(vectors(t), "batch", F.col(CONTROL), n_components=16))


@query("wht_09_tvn_original")
def _(t):
    return shape_report(bt.tvn_original(vectors(t), "batch", F.col(CONTROL), k=20))


@query("wht_10_tvn_cascade")
def _(t):
    return shape_report(bt.tvn_cascade(vectors(t), "batch", F.col(CONTROL), k1=32, k2=6))


@query("wht_11_control_ratio", """SELECT vec_id % 8 AS batch, count(*) FILTER (WHERE vec_id % 5 = 0) AS n_controls,
   CASE WHEN 64.0 / min(count(*) FILTER (WHERE vec_id % 5 = 0)) OVER () > 2.5 THEN min(count(*) FILTER (WHERE vec_id % 5 = 0)) OVER () - 1 ELSE 64 END AS width FROM embeddings GROUP BY 1""")
def _(t):
    pf = vectors(t)
    width = bt.clamp_components(64, bt.smallest_batch(pf, "batch", F.col(CONTROL)))
    return bt.control_counts(pf, "batch", F.col(CONTROL)).select(F.col("batch").cast("bigint").alias("batch"), "n_controls", F.lit(width).cast("bigint").alias("width"))


@query("wht_12_diagnostics")
def _(t):
    pf = normalized(t)
    report = bt.whitening_report(pf, "plate", F.col(CONTROL))
    fitted = bt.spherize_fit(la.global_moments(vectors(t)), remove="mp")
    return report.withColumns({"k_removed": F.lit(fitted.k_removed), "variance_removed": F.lit(fitted.variance_removed)})


@query("win_10_cumulative_variance")
def _(t):
    m = la.global_moments(vectors(t))
    _, ratio = la.pca_components(m, 64)
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, np.cumsum(ratio)))]
    return t.spark.createDataFrame(rows, "component int, ratio double, cumulative double")
