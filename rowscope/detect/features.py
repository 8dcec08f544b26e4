"""Feature matrix and preparation (P10, M1, M2, M7).

A feature matrix is a DataFrame ``(row_id long, x array<double>[, y int])``:
one row per observation, features in a fixed order. Per-feature statistics are
aggregated over the long form ``(row_id, j, v)`` — one group per feature, so the
tables sent back to the rows have one entry per feature (bounded by the width,
never by the row count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.functions.scalars import as_num, col
from rowscope.operators.aggregate import percentiles


EPS = 2.0 ** -52


def from_array(df: DataFrame, id_col: str, array_col: str, label: Column | None = None) -> DataFrame:
    cols = [col(id_col).cast("long").alias("row_id"),
            F.transform(col(array_col), lambda v: v.cast("double")).alias("x")]
    if label is not None:
        cols.append(label.cast("int").alias("y"))
    return df.select(*cols)


def from_columns(df: DataFrame, id_col: str, features: Sequence[str], label: Column | None = None) -> DataFrame:
    cols = [col(id_col).cast("long").alias("row_id"),
            F.array(*[as_num(df, f) for f in features]).alias("x")]
    if label is not None:
        cols.append(label.cast("int").alias("y"))
    return df.select(*cols)


def to_long(fm: DataFrame) -> DataFrame:
    """``(row_id, j, v)``; j is the 0-based feature position."""
    keep = [c for c in ("y",) if c in fm.columns]
    return fm.select("row_id", *keep, F.posexplode("x").alias("j", "v"))


def dims(fm: DataFrame) -> int:
    r = fm.select(F.max(F.size("x"))).first()[0]
    return int(r or 0)


def missing_policy(fm: DataFrame, policy: str = "error") -> DataFrame:
    """M7: ``error`` (default) raises when a feature is missing, ``drop`` removes
    such rows, ``impute_median`` fills the per-feature median."""
    has_null = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    if policy == "drop":
        return fm.where(~has_null)
    if policy == "error":
        bad = fm.where(has_null).limit(1).count()
        if bad:
            raise ValueError("missing feature values; choose policy 'drop' or 'impute_median'")
        return fm
    if policy == "impute_median":
        med = _per_feature(fm, "median")
        arr = F.array(*[F.lit(m) for m in med])
        return fm.withColumn("x", F.zip_with("x", arr, lambda v, m: F.coalesce(F.nanvl(v, F.lit(None)), m)))
    raise ValueError(f"unknown missing-value policy {policy!r}")


def _per_feature(fm: DataFrame, stat: str) -> list[float]:
    """Per-feature statistic as a driver list (one number per feature)."""
    lg = to_long(fm).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if stat == "median":
        tab = percentiles(lg, F.col("v"), [0.5], ["j"], names=["s"])
    else:
        raise ValueError(stat)
    rows = {r["j"]: r["s"] for r in tab.collect()}
    return [rows.get(j) for j in range(dims(fm))]


def feature_stats(fm: DataFrame, robust: bool = False) -> dict[str, list[float]]:
    """Per-feature centre and scale as driver lists (one entry per feature).

    standard: mean and population std (sklearn ``StandardScaler``), std 0 → 1; a variance
    within the rounding error of summing n values about the mean counts as 0.
    robust: median and IQR (q75 − q25), IQR 0 → 1.
    """
    lg = to_long(fm)
    d = dims(fm)
    if robust:
        tab = percentiles(lg, F.col("v"), [0.25, 0.5, 0.75], ["j"], names=["q1", "c", "q3"]).select("j", "c", (F.col("q3") - F.col("q1")).alias("s"))
    else:
        var, mean, n = F.var_pop("v"), F.avg("v"), F.count("v")
        noise = n * EPS * var + F.pow(n * EPS * mean, F.lit(2.0))
        tab = lg.groupBy("j").agg(mean.alias("c"), F.when(var <= noise, 0.0).otherwise(F.sqrt(var)).alias("s"))
    got = {r["j"]: (r["c"], r["s"]) for r in tab.collect()}
    centre = [got.get(j, (0.0, 1.0))[0] for j in range(d)]
    scale = [got.get(j, (0.0, 1.0))[1] for j in range(d)]
    scale = [1.0 if (s is None or s == 0) else s for s in scale]
    return {"centre": centre, "scale": scale}


def apply_scaling(fm: DataFrame, stats: dict[str, list[float]]) -> DataFrame:
    c = F.array(*[F.lit(float(v)) for v in stats["centre"]])
    s = F.array(*[F.lit(float(v)) for v in stats["scale"]])
    z = F.zip_with(F.zip_with("x", c, lambda v, m: v - m), s, lambda v, sd: v / sd)
    return fm.withColumn("x", z)


def standard_scale(fm: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """M1: (x − mean) / population std, fitted on ``fit_on`` (default: itself)."""
    return apply_scaling(fm, feature_stats(fit_on if fit_on is not None else fm))


def robust_scale(fm: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """M2: (x − median) / IQR."""
    return apply_scaling(fm, feature_stats(fit_on if fit_on is not None else fm, robust=True))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over at least ``defaultParallelism`` partitions before a
    CPU-heavy Python step (per-row cost there dwarfs the cost of one shuffle)."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


# ---------------------------------------------------------------- M3-M6

def pca(fm: DataFrame, n_components: int | float | None, fit_on: DataFrame | None = None,
        whiten: bool = False) -> DataFrame:
    """M4/M5/M6: project onto principal components fitted on ``fit_on`` (default: itself).

    ``0 < n_components < 1`` keeps the smallest k whose explained variance share
    reaches it (M4); an integer is clipped to ``[1, min(n, d) - 1]`` (M5). Rows are
    centred first (Spark's PCA does not centre at transform). ``whiten`` divides each
    component by the square root of its variance. Spark ML computes the d × d
    covariance distributedly; only d × d numbers reach the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = fit_on if fit_on is not None else fm
    d = dims(base)
    n = base.count()
    centre = feature_stats(base)["centre"]
    cen = F.array(*[F.lit(float(c)) for c in centre])

    def centred(df):
        return df.withColumn("_v", array_to_vector(F.zip_with("x", cen, lambda v, m: v - m)))

    full = PCA(k=max(1, min(d, n)), inputCol="_v", outputCol="_p").fit(centred(base))
    ev = list(full.explainedVariance.toArray())
    if n_components is None:
        k = len(ev)
    elif isinstance(n_components, float) and 0 < n_components < 1:
        acc, k = 0.0, len(ev)
        for i, e in enumerate(ev):
            acc += e
            if acc >= n_components - 1e-12:
                k = i + 1
                break
    else:
        k = max(1, min(int(n_components), min(n, d) - 1))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(centred(base))
    out = model.transform(centred(fm)).withColumn("x", vector_to_array("_p")).drop("_v", "_p")
    if whiten:
        # variance of each component = share × total variance of the centred data
        total = sum(v * v for v in feature_stats(base)["scale"]) * n / max(n - 1, 1)
        sd = [float((e * total) ** 0.5) or 1.0 for e in ev[:k]]
        out = out.withColumn("x", F.zip_with("x", F.array(*[F.lit(s) for s in sd]), lambda v, s: v / s))
    return out


def quantile_normal(fm: DataFrame, n_quantiles: int = 1000, fit_on: DataFrame | None = None) -> DataFrame:
    """M3: map each feature through its empirical CDF (quantile grid from all rows by
    a mergeable sketch, linear interpolation) and then the standard normal inverse CDF
    (Acklam's rational approximation; no scipy).

    The grid (features × n_quantiles numbers) is the only thing on the driver.
    """
    import numpy as np

    base = fit_on if fit_on is not None else fm
    qs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    grid = (to_long(base).groupBy("j").agg(F.percentile_approx("v", qs, 10 * n_quantiles).alias("g"))
            .collect())
    table = {r["j"]: np.asarray(r["g"], dtype=float) for r in grid}
    refs = np.asarray(qs)
    bc = fm.sparkSession.sparkContext.broadcast((table, refs))

    def ndtri(p):
        # Acklam's rational approximation of the inverse normal CDF
        a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
             1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
        b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
             6.680131188771972e+01, -1.328068155288572e+01]
        c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
        dd = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
        p = np.clip(p, 1e-7, 1 - 1e-7)
        q = np.where(p < 0.5, p, 1 - p)
        r = np.sqrt(-2 * np.log(q))
        tail = (((((c[0] * r + c[1]) * r + c[2]) * r + c[3]) * r + c[4]) * r + c[5]) / \
               ((((dd[0] * r + dd[1]) * r + dd[2]) * r + dd[3]) * r + 1)
        qq = p - 0.5
        rr = qq * qq
        mid = (((((a[0] * rr + a[1]) * rr + a[2]) * rr + a[3]) * rr + a[4]) * rr + a[5]) * qq / \
              (((((b[0] * rr + b[1]) * rr + b[2]) * rr + b[3]) * rr + b[4]) * rr + 1)
        lo = np.where(p < 0.5, tail, -tail)  # the rational form is the (negative) lower tail
        return np.where((p >= 0.02425) & (p <= 1 - 0.02425), mid, lo)

    def run(batches):
        tab, ref = bc.value
        for pdf in batches:
            X = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(tab)))
            out = np.empty_like(X)
            for j in range(X.shape[1]):
                g = tab.get(j)
                out[:, j] = ndtri(np.interp(X[:, j], g, ref)) if g is not None else X[:, j]
            res = pdf.drop(columns=["x"]).copy()
            res["x"] = list(out)
            yield res

    return fm.mapInPandas(run, fm.schema)
