"""Probes of single rules: files at any depth, partial labels, text kept in place, formulas, delays, constants, samples."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowscope.detect import features as M
from rowscope.detect import neighbours, sampling
from rowscope.detect.iterative import average_fit
from rowscope.detect.lof import knn, lof_scores
from rowscope.detect.sampling import tree_samples
from rowscope.operators import evaluate as E
from rowscope.operators import filters as P
from rowscope.operators import text as X
from rowscope.plans import benchmark as B
from rowscope.plans.actions import run_actions
from rowscope.sources.csv import read_csv_dir


def test_csv_files_at_any_depth(spark, tmp_path):
    (tmp_path / "valve1" / "deep").mkdir(parents=True)
    for i, p in enumerate([tmp_path / "a.csv", tmp_path / "valve1" / "b.csv", tmp_path / "valve1" / "deep" / "c.csv"], 1):
        p.write_text(f"datetime;x\n2020-01-01 00:00:0{i};{i}\n")
    (tmp_path / "note.txt").write_text("no table\n")
    got = {(r["x"], r["group"]) for r in read_csv_dir(spark, str(tmp_path)).collect()}
    assert got == {(1, ""), (2, "valve1"), (3, "valve1")}
    assert [r["x"] for r in read_csv_dir(spark, str(tmp_path / "a.csv")).collect()] == [1]


def test_roc_auc_ignores_unlabelled_rows(spark):
    rows = [("d", float(i), 1 if i >= 8 else 0) for i in range(10)] + [("d", s, None) for s in (0.5, 20.0, 8.5)]
    df = spark.createDataFrame(rows, "algo string, score double, y int")
    m = E.metrics(df).first()
    assert m["roc_auc"] == 1.0 and m["pr_auc"] == 1.0
    pts, auc = E.roc_curve(df)
    assert auc.first()["roc_auc_trapezoid"] == 1.0


def test_tokens_are_corrected_in_place(spark):
    texts = spark.createDataFrame([(1, "Sort by Machin_ID > 30, then top 5!"), (2, "123 456"), (3, None), (4, "")], "id int, s string")
    vocab = spark.createDataFrame([("Machine_ID",), ("Energy_Use",)], "name string")
    got = {r["id"]: r["corrected"] for r in X.correct_tokens(texts, "id", "s", vocab, "name").collect()}
    assert got == {1: "Sort by Machine_ID > 30, then top 5!", 2: "123 456", 3: None, 4: ""}


@pytest.mark.parametrize("formula,want", [("abs(a) / b", None), ("a / greatest(b, 2)", 3.0), ("a / 2e0", 3.0), ("a / -b", None),
                                          ("a / (b + 3) / b", None), ("1 + a % b", None)])
def test_safe_formulas(spark, formula, want):
    df = spark.createDataFrame([(-6.0 if "abs" in formula else 6.0, 0.0)], "a double, b double")
    assert P.add_derived_column(df, "q", formula, safe=True).first()["q"] == want
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_not_equal_in_compounds(spark):
    df = spark.createDataFrame([(3, "a"), (7, "b"), (None, "a!=3"), (4, None)], "v int, s string")
    ids = lambda q: [tuple(r) for r in P.select_rows(df, q, missing_matches_ne=True).collect()]
    assert ids("v != 3 or v > 5") == [(7, "b"), (None, "a!=3"), (4, None)]
    assert ids("s != 'a' and v != 7") == [(None, "a!=3"), (4, None)]
    assert ids("s = 'a!=3'") == [(None, "a!=3")]


def test_delay_means_feed_later_formulas(spark):
    df = spark.createDataFrame([("m", "2020-01-01 00:10:00", "2020-01-01 00:00:00"), ("m", "2020-01-01 00:30:00", "2020-01-01 00:00:00"),
                                ("n", "2020-01-01 00:20:00", "2020-01-01 00:00:00")], "g string, a string, b string")
    res = run_actions(df, [{"function": "calculate_delay_avg", "args": {"column1": "a", "column2": "b"}},
                           {"function": "add_derived_column", "args": {"name": "off", "formula": "delay - {last_scalar}"}}])
    assert sorted(r["off"] for r in res.cursor.collect()) == [-10.0, 0.0, 10.0]
    by = run_actions(df, [{"function": "calculate_delay_avg_grouped", "args": {"column1": "a", "column2": "b", "group_column": "g"}}])
    assert {tuple(r) for r in by.side[0][1].collect()} == {("m", 20.0), ("n", 20.0)}
    with pytest.raises(ValueError):
        run_actions(df, [{"function": "add_derived_column", "args": {"name": "off", "formula": "1 - {last_scalar}"}}])


def test_action_orders_are_total(spark):
    df = spark.createDataFrame([("m", i % 3, float(i)) for i in range(30)], "g string, k int, v double").repartition(5)
    act = [{"function": "rolling_average", "args": {"group_by": "g", "column": "v", "window": 4}}]
    one = sorted(map(tuple, run_actions(df, act).cursor.collect()))
    assert one == sorted(map(tuple, run_actions(df.repartition(3), act).cursor.collect()))
    low = run_actions(df, [{"function": "top_n", "args": {"n": 2, "column": "v", "order": "asc"}}]).cursor
    assert [r["v"] for r in low.collect()] == [0.0, 1.0]


@pytest.mark.parametrize("value,rows,parts", [(13.7, 1001, 3), (1000.1, 5000, 7), (0.0, 10, 2)])
def test_constant_features_scale_to_zero(spark, value, rows, parts):
    fm = spark.range(rows).repartition(parts).select(F.col("id").alias("row_id"), F.array(F.lit(value), F.col("id").cast("double")).alias("x"))
    z = M.standard_scale(fm).select(F.max(F.abs(F.col("x")[0])).alias("c"), F.stddev_pop(F.col("x")[1]).alias("s")).first()
    assert z["c"] < 1e-9 and z["s"] == pytest.approx(1)


def test_quantile_grid_uses_all_rows(spark):
    fm = spark.range(30000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    got = M.quantile_normal(fm).where("row_id in (0, 15000, 29999)").orderBy("row_id").collect()
    assert got[0]["x"][0] < -5 and abs(got[1]["x"][0]) < 0.01 and got[2]["x"][0] > 5


def test_tree_samples(spark):
    fm = spark.range(5000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    s, psi = tree_samples(fm, 40, 64)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and psi == 64
    rows = s.select("tree", "row_id").collect()
    per = {}
    for r in rows:
        per.setdefault(r["tree"], set()).add(r["row_id"])
    assert len(per) == 40 and all(len(v) == 64 for v in per.values())
    drawn = np.array([r["row_id"] for r in rows])
    assert abs(drawn.mean() / 2500 - 1) < 0.06 and len(set(drawn.tolist())) > 1500  # uniform, and trees differ
    again = {(r["tree"], r["row_id"]) for r in tree_samples(fm.repartition(7), 40, 64)[0].collect()}
    assert again == {(r["tree"], r["row_id"]) for r in rows}
    all_rows, psi = tree_samples(fm.where("row_id < 50"), 3, 256)
    assert psi == 50 and all_rows.count() == 150
    big = tree_samples(fm, 2, 2000)[0]
    assert "WindowGroupLimit" in big._jdf.queryExecution().executedPlan().toString()


def test_tree_samples_of_ids_that_share_a_residue(spark):
    """Ids that agree modulo the hashes' prime are drawn independently of each other."""
    step = sampling.MODULUS
    fm = spark.range(4000).select((F.col("id") * step + 7).alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    rows = tree_samples(fm, 60, 32)[0].select("tree", F.expr(f"row_id div {step}").alias("i")).collect()
    per = {}
    for r in rows:
        per.setdefault(r["tree"], set()).add(r["i"])
    assert len(per) == 60 and all(len(v) == 32 for v in per.values())
    drawn = np.array([r["i"] for r in rows])
    assert abs(drawn.mean() / 2000 - 1) < 0.06 and len(set(drawn.tolist())) > 1400
    shared = [len(per[a] & per[b]) for a in range(60) for b in range(a)]
    assert np.mean(shared) < 3 * 32 * 32 / 4000  # as independent trees share


def test_tree_samples_have_the_binomial_share(spark):
    fm = spark.range(20000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    per = {r["row_id"]: r["c"] for r in tree_samples(fm, 100, 200)[0].groupBy("row_id").agg(F.count("*").alias("c")).collect()}
    counts = np.bincount([*per.values(), *[0] * (20000 - len(per))], minlength=6) / 20000
    want = [math.comb(100, i) * 0.01 ** i * 0.99 ** (100 - i) for i in range(6)]
    assert np.abs(counts[:6] - want).max() < 0.02


def _clusters(spark, n):
    r = np.random.default_rng(3)
    of, centre, plane = r.integers(0, 30, n), r.normal(size=(30, 24)) * 4, r.normal(size=(30, 4, 24))
    x = centre[of] + np.einsum("ni,nij->nj", r.normal(size=(n, 4)), plane[of]) + 0.05 * r.normal(size=(n, 24))
    x[: n // 5] = x[0]  # equal rows cannot be told apart by any projection
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").cache()


def test_hashed_neighbours_reach_the_recall_and_hold_exact_distances(spark):
    fm = _clusters(spark, 2500)
    near = neighbours.hashed_knn(fm, 10, cell_rows=64, recall=0.9)
    exact = knn(fm, 10).select("row_id", "nbr_id", F.col("dist").alias("d"))
    both = near.table.join(exact, ["row_id", "nbr_id"])
    values = near.table.select("row_id", "rank", "dist").join(exact.withColumn("rank", F.row_number().over(
        Window.partitionBy("row_id").orderBy("d", "nbr_id"))).select("row_id", "rank", "d"), ["row_id", "rank"])
    assert both.where("abs(dist - d) > 1e-9").count() == 0
    # equal rows have any of their equals as neighbours: compare distances
    assert values.where("dist <= d + 1e-9").count() >= 0.9 * exact.count()
    assert near.method == "hashed" and near.recall >= 0.9 and near.table.groupBy("row_id").count().where("count <> 10").count() == 0
    scores = lof_scores(fm, 10, method="hashed", cell_rows=64)
    assert {"method", "recall"} < set(scores.columns) and scores.count() == 2500


def test_hashed_neighbours_make_no_block_pairs(spark):
    fm = _clusters(spark, 600)
    made = [neighbours.Table(np.stack([r["x"] for r in fm.collect()]), 600, 64, np.random.default_rng(1)) for _ in range(3)]
    rows = neighbours._candidates(fm, made, 0, 5, "manhattan", 64)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows.count() <= 3 * 600 * 5


def test_rows_with_a_limit_meet_once(monkeypatch):
    """The sums of a pair serve both of its rows, and the lists equal those made without limits."""
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 24))
    x[5] *= 40
    x[70, 3] = np.nan
    x[100:140] = x[100]
    ids = np.arange(3000)
    ids[9] = 8
    plain = neighbours.Nearest(x, ids, 5, "manhattan")
    plain.meet(x, ids)
    kth = plain.best.bound()
    pairs = []
    for name in ("_byte_sums", "_absolute_sums"):
        taken = getattr(neighbours, name)
        monkeypatch.setattr(neighbours, name, lambda a, b, taken=taken: (pairs.append(a.shape[1] * b.shape[1]), taken(a, b))[1])
    for limit in (kth, np.where(np.isfinite(kth), 1.2 * kth, np.inf), np.where(r.random(3000) < 0.05, np.inf, kth), np.full(3000, np.inf)):
        pairs.clear()
        near = neighbours.Nearest(x, ids, 5, "manhattan", limit)
        near.meet_own()
        assert np.array_equal(near.best.id, plain.best.id) and np.array_equal(near.best.value, plain.best.value)
        if limit is kth:
            assert sum(pairs) < 0.65 * 3000 ** 2
    # a limit below the k-th distance: only others within it are listed
    near = neighbours.Nearest(x, ids, 5, "manhattan", 0.9 * kth)
    near.meet_own()
    want = np.where(plain.best.value <= 0.9 * kth[:, None], plain.best.value, np.inf)
    assert np.array_equal(near.best.value, want)


def test_later_tables_offer_only_what_can_enter_the_lists(spark):
    fm = _clusters(spark, 600)
    points = np.stack([r["x"] for r in fm.collect()])
    made = [neighbours.Table(points, 600, 64, np.random.default_rng(i)) for i in range(3)]
    first = neighbours._ranked(neighbours._candidates(fm, made[:2], 0, 5, "manhattan", 64).groupBy("row_id", "nbr_id").agg(
        F.min("dist").alias("dist")), 5).cache()
    all_of_it = neighbours._candidates(fm, made[2:], 2, 5, "manhattan", 64)
    bounded = neighbours._candidates(fm, made[2:], 2, 5, "manhattan", 64, first)
    kth = first.where("rank = 5").select("row_id", F.col("dist").alias("kth"))
    want = {tuple(r) for r in all_of_it.join(kth, "row_id", "left").where("kth is null or dist <= kth").drop("kth").collect()}
    got = {tuple(r) for r in bounded.collect()}
    assert got == want and len(got) < all_of_it.count()


def test_kbest_over_blocks_equals_a_sort():
    r = np.random.default_rng(5)
    values = r.integers(0, 30, (7, 400)).astype(float)
    values[:, r.random(400) < 0.1] = np.inf
    best = neighbours.KBest(7, 6)
    for at in range(0, 400, 37):
        best.offer(np.arange(7), values[:, at:at + 37], np.arange(at, min(400, at + 37)))
    for q in range(7):
        want = sorted((v, i) for i, v in enumerate(values[q]) if np.isfinite(v))[:6]
        assert list(zip(best.value[q].tolist(), best.id[q].tolist(), strict=True)) == want


def test_average_fit_sees_every_row(spark):
    fm = spark.range(1000).repartition(6).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    step = lambda p, X, rng, st: ({"m": np.array([X.mean()]), "big": np.full((3, 2), X.mean())}, float(len(X)))
    params, history = average_fit(fm, {"m": np.zeros(1), "big": np.zeros((3, 2))}, step, rounds=2)
    assert params["m"][0] == pytest.approx(499.5) and params["big"].shape == (3, 2)
    assert len(history) == 2 and history[0]["train_loss"] == pytest.approx(1.0)


def test_benchmark_table_prepares_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), None if i % 50 == 11 else float(rng.normal()), "t", int(i < 5)) for i in range(300)]
    rows = [(i, a + 8 * y, None if b is None else b + 8 * y, s, y) for i, a, b, s, y in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, s string, anomaly int")
    with pytest.raises(ValueError):
        B.benchmark_table(df, "id", label="anomaly", algos=["COPOD"])
    train = df.where("anomaly = 0").select("id", "b", "a")
    for policy, n in (("drop", 294), ("impute_median", 300)):
        res = B.benchmark_table(df, "id", label="anomaly", train=train, algos=["COPOD"], missing=policy, smooth={})
        assert res.scores.count() == n and res.board.first()["pr_auc"] > 0.9
    assert res.best.first()["best_algo"] == "COPOD"


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from rowscope import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_autoencoder_windows_score_every_row(spark):
    from rowscope.detect.autoencoder import autoencoder_scores

    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=3) + (9 if 60 <= i < 64 else 0)]) for i in range(120)]
    fm = spark.createDataFrame(rows, "row_id long, x array<double>")
    got = {r["row_id"]: r["score"] for r in autoencoder_scores(fm, preset="simple", epochs=10, windows=(4, 1)).collect()}
    assert sorted(got) == list(range(120))
    assert max(got, key=got.get) in range(58, 67)
