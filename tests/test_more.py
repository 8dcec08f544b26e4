"""PCA, quantile transform, interval concurrency vs pandas, thresholds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowscope.detect import features as M
from rowscope.operators import evaluate as E
from rowscope.operators.intervals import concurrency, freq_seconds


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(21)
    X = rng.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    pdf = pd.DataFrame({"row_id": np.arange(300), "x": list(X)})
    return X, spark.createDataFrame(pdf, "row_id long, x array<double>").repartition(3)


def test_pca_variance_share_and_distances(cloud):
    X, fm = cloud
    Xc = X - X.mean(axis=0)
    ev = np.linalg.svd(Xc, compute_uv=False) ** 2
    share = np.cumsum(ev) / ev.sum()
    k_exp = int(np.searchsorted(share, 0.9) + 1)
    got = M.pca(fm, 0.9).toPandas().sort_values("row_id")
    Z = np.stack(got["x"].to_numpy())
    assert Z.shape[1] == k_exp
    full = np.stack(M.pca(fm, 4).toPandas().sort_values("row_id")["x"].to_numpy())
    assert full.shape[1] == 4  # 4 = min(n, d) - 1
    # a rotation: pairwise distances of the first 4 components equal those of the SVD projection
    U, S, Vt = np.linalg.svd(Xc, full_matrices=False)
    P = Xc @ Vt[:4].T
    d1 = np.linalg.norm(full[:20, None] - full[None, :20], axis=-1)
    d2 = np.linalg.norm(P[:20, None] - P[None, :20], axis=-1)
    assert np.allclose(d1, d2, atol=1e-8)


def test_quantile_normal_is_monotone_and_centered(cloud):
    X, fm = cloud
    got = M.quantile_normal(fm, n_quantiles=200).toPandas().sort_values("row_id")
    Z = np.stack(got["x"].to_numpy())
    for j in range(X.shape[1]):
        order = np.argsort(X[:, j])
        assert np.all(np.diff(Z[order, j]) >= -1e-9)
        assert abs(np.median(Z[:, j])) < 0.1


def test_concurrency_matches_pandas_resample(spark):
    rng = np.random.default_rng(22)
    start = pd.Timestamp("2024-03-01 08:07") + pd.to_timedelta(rng.integers(0, 600, 80), unit="min")
    dur = pd.to_timedelta(rng.integers(0, 120, 80), unit="min")
    pdf = pd.DataFrame({"s": start, "e": start + dur})
    pdf.loc[3, "e"] = pd.NaT
    df = spark.createDataFrame(pdf.astype({"s": "datetime64[us]", "e": "datetime64[us]"}))
    df = df.select(F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e"))
    got = concurrency(df, "s", "e", "30T").toPandas().sort_values("bucket")
    ev = pd.concat([pd.DataFrame({"t": pdf["s"], "d": 1}), pd.DataFrame({"t": pdf["e"], "d": -1})]).dropna()
    ev = ev.sort_values(["t", "d"], ascending=[True, False])
    exp = ev.set_index("t")["d"].cumsum().resample("30min").mean().ffill()
    assert got["concurrent"].round(9).tolist() == exp.round(9).tolist()
    assert [pd.Timestamp(b) for b in got["bucket"]] == list(exp.index)
    assert freq_seconds("10T") == 600 and freq_seconds("1H") == 3600


def test_thresholds_and_pot(spark):
    rng = np.random.default_rng(23)
    v = rng.exponential(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"score": v}))
    r = E.score_thresholds(df, "score", 0.995, 3.0).first()
    med = np.median(v)
    assert abs(r["thr_quantile"] - np.quantile(v, 0.995)) < 1e-9
    assert abs(r["thr_std"] - (v.mean() + 3 * v.std())) < 1e-9
    assert abs(r["thr_mad"] - (med + 3 * 1.4826 * (np.median(np.abs(v - med)) + 1e-12))) < 1e-9
    pot = E.pot_threshold(df, "score").first()
    assert pot["method"] == "gpd_moments" and pot["thr_pot"] > np.quantile(v, 0.98)
    # few excesses still fit; only a tail without spread falls back to the quantile
    assert E.pot_threshold(df.limit(150), "score").first()["method"] == "gpd_moments"
    flat = E.pot_threshold(df.withColumn("score", F.lit(1.0)), "score").first()
    assert flat["method"] == "quantile_fallback" and flat["thr_pot"] == 1.0
