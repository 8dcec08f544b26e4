"""Options of the detectors and fits: regularisers, kurtosis-weighted splits, range penalty, likelihood, re-rank."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rowscope.detect import autoencoder as A
from rowscope.detect import iforest, ocsvm
from rowscope.operators import evaluate as E
from rowscope.operators import text as X
from scripts.oracle_check import digest
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("options,loss", [
    ({}, "mse"), ({}, "huber"), ({"dropout": 0.3}, "mse"), ({"l1": 0.05}, "mse"), ({"noise": 0.4}, "mse"),
    ({"activation": "elu"}, "huber"), ({"activation": "leaky_relu"}, "mse"),
    ({"dropout": 0.2, "l1": 0.02, "noise": 0.1, "activation": "elu"}, "huber")])
@pytest.mark.parametrize("batch_norm", [False, True])
def test_gradients_by_finite_differences(options, loss, batch_norm):
    rng = np.random.default_rng(3)
    sizes = [5, 7, 4, 3, 4, 7, 5]
    L = len(sizes) - 1
    p = A._init(sizes, rng, batch_norm)
    for k in p:
        if k[0] in "bgh":
            p[k] = p[k] + rng.normal(0, 0.3, p[k].shape)
    X = rng.normal(size=(11, 5)) * 2

    def objective(q):
        return A._gradients(q, X, L, loss, options, np.random.default_rng(9))[0] / len(X)

    grads = A._gradients(p, X, L, loss, options, np.random.default_rng(9))[1]
    assert any(k.startswith("g") for k in grads) == batch_norm
    for k, g in grads.items():
        for at in list(np.ndindex(g.shape))[::3]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((objective(up) - objective(down)) / 2e-6 - g[at]) < 1e-5, (k, at)


def test_regularisers_act_in_training_only_and_are_checked(spark):
    p = A._init([4, 6, 3, 6, 4], np.random.default_rng(1), False)
    X = np.random.default_rng(2).normal(size=(9, 4))
    options = {"dropout": 0.5, "noise": 1.0}
    assert np.array_equal(A._forward(p, X, 4, options)[0], A._forward(p, X, 4, {})[0])
    assert not np.allclose(A._forward(p, X, 4, options, np.random.default_rng(1))[0], A._forward(p, X, 4, {})[0])
    fm = spark.createDataFrame([(0, [1.0, 2.0])], "row_id long, x array<double>")
    for bad in ({"dropout": 1.0}, {"l1": -1.0}, {"activation": "tanh"}, {"loss": "log"}, {"drop": 0.1}):
        with pytest.raises(ValueError):
            A.autoencoder_scores(fm, preset="simple", **bad)


def test_regularised_autoencoder_finds_planted(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 8))
    X = np.vstack([base, rng.normal(0, 4, size=(15, 8))])
    fm = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(515), "x": list(X), "y": [0] * 500 + [1] * 15}),
                               "row_id long, x array<double>, y int").repartition(3)
    s = A.autoencoder_scores(fm, preset="simple", epochs=30, loss="huber", dropout=0.05, l1=1e-4, noise=0.05, activation="elu")
    assert E.metrics(s.join(fm.select("row_id", "y"), "row_id").withColumn("algo", F.lit("AE"))).first()["pr_auc"] > 0.7


def test_kurtosis_weights():
    rng = np.random.default_rng(7)
    sub = np.column_stack([rng.uniform(size=4000), rng.normal(size=4000), rng.standard_t(3, size=4000)])
    w = iforest.kurtosis_weights(sub)
    z = (sub - sub.mean(axis=0)) / sub.std(axis=0)
    assert abs(w.sum() - 1) < 1e-12 and np.allclose(w, (z ** 4).mean(axis=0) / (z ** 4).mean(axis=0).sum())
    assert w[0] < w[1] < w[2]
    assert np.allclose(iforest.kurtosis_weights(sub * 1e-160 + 0), w)
    # heavy-tailed features are chosen at the root in that proportion
    roots = [iforest._grow(sub[:400], np.random.default_rng(i), 1, 1, True)[0][3][0] for i in range(600)]
    share = np.bincount(roots, minlength=3) / 600
    assert np.abs(share - iforest.kurtosis_weights(sub[:400])).max() < 0.08


def test_range_penalty_by_hand(spark):
    # one split at 1.0 over a node that has seen a range of 4: outside [-3, 5] the path is one shorter
    model = spark.createDataFrame(
        [(0, 0, 1, 2, [0], [1.0], 1.0, 10, 0, 0.0, 4.0), (0, 1, -1, -1, [], [], 0.0, 1, 1, 0.0, 0.0),
         (0, 2, -1, -1, [], [], 0.0, 1, 1, 0.0, 0.0)], iforest._SCHEMA)
    fm = spark.createDataFrame([(i, [v]) for i, v in enumerate([0.0, 2.0, -3.0, 5.0, -3.1, 5.1, 99.0])], "row_id long, x array<double>")
    c = float(iforest.c_factor(10))
    got = {r[0]: r[1] for r in iforest.score(fm, model, 10, penalize_range=True).collect()}
    assert all(abs(got[i] - 2 ** (-1 / c)) < 1e-12 for i in range(4)) and all(got[i] == 1.0 for i in (4, 5, 6))
    assert all(abs(r[1] - 2 ** (-1 / c)) < 1e-12 for r in iforest.score(fm, model, 10).collect())


def _profile(y, th):
    k = np.log1p(np.outer(th, y)).mean(axis=1)
    return -np.log(k / th) - k - 1


@pytest.mark.parametrize("xi", [0.4, 0.1, -0.25])
def test_pot_likelihood_is_the_maximum(spark, xi):
    rng = np.random.default_rng(int(100 * xi) + 50)
    v = 3.0 * ((1 - rng.uniform(size=20_000)) ** -xi - 1) / xi
    df = spark.createDataFrame(pd.DataFrame({"score": v})).repartition(5)
    r = E.pot_likelihood(df, "score", base_q=0.9).first()
    t = np.quantile(v, 0.9)
    y = v[v > t] - t
    assert r["method"] == "gpd_likelihood" and r["n_excess"] == len(y)
    th, best = r["xi"] / r["sigma"], r["xi"]
    near = th * (1 + np.linspace(-0.2, 0.2, 400))
    near = near[1 + near * y.max() > 0]
    assert _profile(y, np.array([th]))[0] >= _profile(y, near).max() - 1e-12
    assert abs(np.log1p(th * y).mean() - best) < 1e-8
    assert abs((1 + best) * (1 / (1 + th * y)).mean() - 1) < 1e-7
    assert abs(best - xi) < 0.12
    assert abs(r["thr_pot"] - (t + r["sigma"] / best * (1e-3 ** -best - 1))) < 1e-8


def test_pot_likelihood_edges(spark):
    flat = spark.createDataFrame([(1.0,)] * 50 + [(None,)], "score double")
    r = E.pot_likelihood(flat, "score").first()
    assert r["method"] == "quantile_fallback" and r["thr_pot"] == 1.0 and r["xi"] is None
    r = E.pot_likelihood(flat.where("false"), "score").first()
    assert r["method"] == "quantile_fallback" and r["thr_pot"] is None and r["n_excess"] == 0


def test_rerank(spark):
    m = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.8, 2), ("b", "x", 0.9, 1), ("b", "z", 0.85, 2), ("c", "x", 0.9, 1),
                               ("c", "y", 0.8, 2), ("d", "y", 0.9, 1), ("d", "w", 0.9, 2)], "token string, match string, sim double, rank int")
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0]), ("d", [0.0, 2.0])], "token string, x array<double>")
    right = spark.createDataFrame([("x", [0.5, 1.0]), ("y", [3.0, 0.1]), ("w", [3.0, 0.1])], "match string, x array<double>")
    got = {r["token"]: (r["match"], r["cosine"]) for r in X.rerank(m, left, right).collect()}
    assert got["a"][0] == "y" and got["b"][0] == "x"  # z has no vector
    assert got["c"] == ("x", None) and got["d"][0] == "y"  # no direction; a tie
    assert X.rerank(m.where("false"), left, right).count() == 0
    texts = spark.createDataFrame([(1, "sum of pric by day")], "id long, text string")
    vocab = spark.createDataFrame([("price",), ("prick",)], "name string")
    nearer = spark.createDataFrame([("price", [1.0, 0.0]), ("prick", [0.0, 1.0])], "match string, x array<double>")
    for vec, want in (([1.0, 0.2], "price"), ([0.2, 1.0], "prick")):
        own = spark.createDataFrame([("pric", vec)], "token string, x array<double>")
        out = X.correct_tokens(texts, "id", "text", vocab, "name", vectors=(own, nearer)).first()
        assert out["corrected"] == f"sum of {want} by day"


@pytest.mark.parametrize("name", ["pot_likelihood", "fuzzy_rerank", "eif_run_alone_properties"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols) and rows
    assert digest(df.columns, rows)[0] == digest(cols, want)[0], (rows[:3], want[:3])


def test_ocsvm_reaches_the_optimum(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 1, (900, 4)), rng.normal(0, 4, (100, 4))])
    fm = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1000), "x": X.tolist()}))
    W, b = rng.normal(0, 0.5, (4, 24)), rng.uniform(0, 2 * np.pi, 24)
    Z = ocsvm._features(X, W, b)
    for nu in (0.05, 0.3):
        w, rho = ocsvm.fit(fm, spark.sparkContext.broadcast((W, b)), nu, 24)
        m = Z @ w

        def objective(v, r, nu=nu):
            return 0.5 * v @ v - r + np.maximum(0, r - Z @ v).sum() / (nu * len(Z))

        # plain subgradient steps from several sizes do not get below it
        best = np.inf
        for rate in (0.3, 0.1):
            v, r = Z.mean(axis=0), 0.0
            for i in range(4000):
                bad = Z @ v < r
                v, r = v - rate / (1 + i / 50) * (v - Z[bad].sum(axis=0) / (nu * len(Z))), r - rate / (1 + i / 50) * (bad.sum() / (nu * len(Z)) - 1)
                best = min(best, objective(v, r))
        assert objective(w, rho) <= best + 1e-3 * abs(best)
        assert abs((m < rho).mean() - nu) <= 0.02
    assert ocsvm.ocsvm_scores(fm.where("false")).count() == 0
