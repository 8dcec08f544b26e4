"""Properties of the shared machinery: partition invariance, exactness vs pandas/numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowscope.operators import aggregate as A
from rowscope.operators import evaluate as E
from rowscope.operators import order as O
from rowscope.operators import sequence as W
from rowscope.operators.intervals import forward_fill
from rowscope.operators.text import fuzzy_match
from rowscope.plans.ordering import prefix_sums, row_index


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_prefix_sums_partition_invariant(spark, parts):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "k": rng.permutation(300).astype(float),
                        "v": rng.integers(0, 10, 300)})
    pdf.loc[pdf.g == 0, "g"] = 0  # one group is hot by construction
    df = spark.createDataFrame(pdf).repartition(parts)
    got = prefix_sums(df, "k", ["v"], ["g"], partitions=5).toPandas().sort_values(["g", "k"])
    exp = pdf.sort_values(["g", "k"]).groupby("g")["v"].cumsum()
    assert got["cum_v"].tolist() == exp.tolist()
    desc = prefix_sums(df, "k", ["v"], ["g"], descending=True, partitions=4).toPandas().sort_values(["g", "k"])
    exp_d = pdf.sort_values(["g", "k"], ascending=[True, False]).groupby("g")["v"].cumsum()
    assert desc.sort_values(["g", "k"], ascending=[True, False])["cum_v"].tolist() == exp_d.tolist()


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_row_index_dense_and_ordered(spark, parts):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.integers(0, 4, 200), "id": np.arange(200)})  # heavy ties on a
    df = spark.createDataFrame(pdf).repartition(parts)
    got = row_index(df, ["a", "id"], partitions=5).toPandas().sort_values("row_idx")
    assert got["row_idx"].tolist() == list(range(200))
    exp = pdf.sort_values(["a", "id"])["id"].tolist()
    assert got["id"].tolist() == exp


def test_percentiles_exact_with_hot_group(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(500) < 0.6, 0, rng.integers(1, 5, 500))
    pdf = pd.DataFrame({"g": g, "v": rng.integers(0, 40, 500).astype(float)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = A.percentiles(df, "v", [0.0, 0.37, 0.5, 0.9, 1.0], ["g"], names=["a", "b", "c", "d", "e"],
                        partitions=6).toPandas().set_index("g").sort_index()
    for grp, sub in pdf.groupby("g"):
        exp = np.quantile(sub["v"], [0.0, 0.37, 0.5, 0.9, 1.0])
        assert np.allclose(got.loc[grp, ["a", "b", "c", "d", "e"]].to_numpy(float), exp)


def test_top_n_is_sort_limit(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"v": rng.integers(0, 5, 50).astype(float), "id": np.arange(50)})
    df = spark.createDataFrame(pdf)
    got = [r["id"] for r in O.top_n(df, 7, "v", tiebreak=["id"]).collect()]
    exp = pdf.sort_values(["v", "id"], ascending=[False, True])["id"].head(7).tolist()
    assert got == exp


def test_ap_auc_properties(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(300) < 0.2).astype(int)
    s = rng.normal(size=300) + y
    pdf = pd.DataFrame({"algo": "a", "score": np.round(s, 1), "y": y})
    df = spark.createDataFrame(pdf)
    m = E.metrics(df).first()
    assert 0 <= m["pr_auc"] <= 1 and 0 <= m["roc_auc"] <= 1
    mono = E.metrics(df.withColumn("score", F.exp("score"))).first()
    assert abs(mono["pr_auc"] - m["pr_auc"]) < 1e-12
    neg = E.metrics(df.withColumn("score", -F.col("score"))).first()
    assert abs(neg["roc_auc"] - (1 - m["roc_auc"])) < 1e-12
    _, trap = E.roc_curve(df)
    assert abs(trap.first()["roc_auc_trapezoid"] - m["roc_auc"]) < 1e-12
    # brute-force AP over distinct thresholds (tied scores are one step)
    order = pdf.groupby("score")["y"].agg(["sum", "count"]).sort_index(ascending=False)
    tp = order["sum"].cumsum()
    fp = (order["count"] - order["sum"]).cumsum()
    ap = float((order["sum"] * tp / (tp + fp)).sum() / y.sum())
    assert abs(ap - m["pr_auc"]) < 1e-12


def test_smooth_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=57)
    pdf = pd.DataFrame({"t": np.arange(57), "x": x})
    df = spark.createDataFrame(pdf).repartition(3)
    for k in (1, 5, 11):
        got = W.smooth(df, "x", ["t"], k=k, name="s", block_rows=10).toPandas().sort_values("t")["s"]
        pad = k // 2
        exp = np.convolve(np.pad(x, (pad, pad), mode="edge"), np.ones(k) / k, mode="valid") if k > 1 else x
        assert np.allclose(got.to_numpy(), exp)


def test_rolling_average_hot_group(spark):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(300) < 0.7, 1, rng.integers(2, 5, 300))
    pdf = pd.DataFrame({"g": g, "t": np.arange(300), "v": rng.normal(size=300)})
    df = spark.createDataFrame(pdf).repartition(4)
    got = W.rolling_average(df, "g", "v", ["t"], window=4, block_rows=16).toPandas().sort_values("t")
    exp = pdf.sort_values("t").groupby("g")["v"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    assert np.allclose(got["v_rollavg_4"].to_numpy(), exp.to_numpy())


def test_forward_fill_across_blocks(spark):
    vals = [None, 1.0, None, None, 2.0] + [None] * 20 + [3.0, None]
    pdf = pd.DataFrame({"k": np.arange(len(vals)), "m": vals})
    df = spark.createDataFrame(pdf, "k long, m double")
    got = forward_fill(df, "k", "m", block=4).toPandas().sort_values("k")["m"]
    exp = pdf["m"].ffill()
    assert got.fillna(-1).tolist() == exp.fillna(-1).tolist()


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_fuzzy_prefix_blocking_is_exact(spark, threshold):
    rng = np.random.default_rng(8)
    alpha = list("abcde")
    words = ["".join(rng.choice(alpha, size=rng.integers(1, 9))) for _ in range(150)]
    left = spark.createDataFrame([(w,) for w in words[:90]], "w string")
    right = spark.createDataFrame([(w,) for w in words[60:]], "w string")
    got = {(r["token"], r["match"]) for r in fuzzy_match(left, right, "w", "w", threshold, top=1000).collect()}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, cb in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
        return d[-1]

    exp = {(a, b) for a in set(words[:90]) for b in set(words[60:])
           if 1 - lev(a, b) / max(len(a), len(b)) >= threshold - 1e-12}
    assert got == exp


@pytest.mark.parametrize("grouped", [True, False])
def test_prefix_sums_cut_groups(spark, grouped):
    """Groups cut into several pieces, null group included; totals of the groups; no literal maps in the plan."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", "-"], 400), "k": rng.permutation(400).astype(float),
                        "v": rng.integers(0, 10, 400)})
    df = spark.createDataFrame(pdf).repartition(3)
    group = ["g"] if grouped else []
    base = pdf.sort_values(group + ["k"])
    exp = base.groupby("g")["v"].cumsum() if grouped else base["v"].cumsum()
    total = base.groupby("g")["v"].transform("sum") if grouped else pd.Series([base["v"].sum()] * 400)
    nulls = df.withColumn("g", F.when(F.col("g") != "-", F.col("g")))
    for partitions in (1, 6, 50):
        out = prefix_sums(nulls, "k", ["v"], group, partitions=partitions, total_prefix="all_")
        got = out.fillna("-", ["g"]).toPandas().sort_values(group + ["k"])
        assert got["cum_v"].tolist() == exp.tolist() and got["all_v"].tolist() == total.tolist()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "map(" not in plan


def test_prefix_sums_timestamp_key_cuts(spark):
    rng = np.random.default_rng(13)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(300), unit="s")
    pdf = pd.DataFrame({"t": ts.astype("datetime64[us]"), "v": rng.integers(0, 5, 300)})
    df = spark.createDataFrame(pdf).select(F.col("t").cast("timestamp_ntz").alias("t"), "v")
    got = prefix_sums(df, "t", ["v"], partitions=7).toPandas().sort_values("t")
    assert got["cum_v"].tolist() == pdf.sort_values("t")["v"].cumsum().tolist()


def test_retrieval_blocked_path_equals_broadcast(spark, monkeypatch):
    from rowscope.operators import text as X
    rng = np.random.default_rng(14)
    C = rng.normal(size=(150, 8))
    corpus = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(150), "x": list(C)}),
                                   "row_id long, x array<double>")
    queries = corpus.where("row_id % 3 = 0")
    a = sorted(tuple(r) for r in X.retrieve_topk(corpus, queries, k=5).collect())
    monkeypatch.setattr(X, "MAX_BROADCAST_QUERIES", 10)
    b = sorted(tuple(r) for r in X.retrieve_topk(corpus, queries, k=5, block_rows=16).collect())
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b])
    Cn = C / np.linalg.norm(C, axis=1, keepdims=True)
    S = Cn[::3] @ Cn.T
    top = np.argsort(-S, axis=1, kind="stable")[:, :5]
    assert [r[1] for r in sorted(a, key=lambda r: (r[0], r[2])) if r[0] == 0] == list(top[0])
