"""Detectors on planted outliers: every detector must rank them high."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowscope.detect import features as M
from rowscope.detect.autoencoder import autoencoder_scores
from rowscope.detect.copod import copod_scores
from rowscope.detect.iforest import iforest_scores
from rowscope.detect.inne import inne_scores
from rowscope.detect.lof import lof_scores
from rowscope.detect.ocsvm import ocsvm_scores
from rowscope.operators import evaluate as E
from rowscope.plans.benchmark import parse_algos, run_benchmark


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    normal = rng.normal(0, 1, size=(400, 6))
    out = rng.normal(0, 1, size=(20, 6)) + rng.choice([-7, 7], size=(20, 6))
    X = np.vstack([normal, out])
    y = np.r_[np.zeros(400, int), np.ones(20, int)]
    pdf = pd.DataFrame({"row_id": np.arange(420), "x": list(X), "y": y})
    return spark.createDataFrame(pdf, "row_id long, x array<double>, y int").repartition(3)


def _ap(scores, fm):
    s = scores.join(fm.select("row_id", "y"), "row_id").withColumn("algo", F.lit("a"))
    return E.metrics(s).first()["pr_auc"]


@pytest.mark.parametrize("name,fn", [
    ("copod", lambda fm: copod_scores(fm)),
    ("inne", lambda fm: inne_scores(fm, 50, 64)),
    ("lof", lambda fm: lof_scores(M.standard_scale(fm), k=20)),
    ("iforest_depth", lambda fm: iforest_scores(fm, 60, 128, 1, "depth")),
    ("eif_density", lambda fm: iforest_scores(fm, 60, 128, 1, "density")),
    ("eif_ndim2", lambda fm: iforest_scores(fm, 60, 128, 2, "depth")),
    ("ocsvm", lambda fm: ocsvm_scores(M.standard_scale(fm), rounds=5)),
    ("autoencoder", lambda fm: autoencoder_scores(fm, epochs=8)),
])
def test_detector_finds_planted_outliers(planted, name, fn):
    scores = fn(planted)
    assert scores.count() == 420
    assert _ap(scores, planted) >= 0.8, name


def test_parse_algos():
    assert parse_algos("all") == ["EIF", "LOF", "COPOD", "INNE", "OCSVM", "AE"]
    assert parse_algos("lof, isolationforest") == ["LOF", "EIF"]
    assert parse_algos(None)[0] == "EIF"
    with pytest.raises(ValueError):
        parse_algos("lofx")


def test_benchmark_records_failures(planted):
    def boom(fm, train=None):
        raise RuntimeError("bad detector")

    res = run_benchmark(planted, ["COPOD", "LOF"], scorers={"COPOD": lambda fm, t=None: copod_scores(fm),
                                                             "LOF": boom})
    board = {r["algo"]: r for r in res.board.collect()}
    assert board["LOF"]["status"] == "failed" and board["COPOD"]["status"] == "ok"
    assert res.best.first()["best_algo"] == "COPOD"


def test_failed_detector_ends_the_benchmark_queries(spark, monkeypatch):
    """Tables without a status column are made of all three detectors or not at all."""
    from rowscope.plans import benchmark
    from rowscope.plans.catalog import load

    def boom(fm, train=None):
        raise RuntimeError("bad detector")

    for name in ("INNE", "COPOD"):
        monkeypatch.setitem(benchmark.SCORERS, name, boom)
    for query in ("benchmark_best", "benchmark_leaderboard", "pseudo_evaluation", "pseudo_labels", "merged_scores"):
        with pytest.raises(RuntimeError, match="COPOD failed.*bad detector"):
            load()[0][query](spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        run_benchmark(None, failures="ignore")
