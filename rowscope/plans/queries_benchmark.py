"""Registered queries for the detector benchmark and its evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscope.detect.autoencoder import autoencoder_scores
from rowscope.detect.ocsvm import ocsvm_scores
from rowscope.detect import features as M
from rowscope.operators import evaluate as E
from rowscope.plans import benchmark as B
from rowscope.plans.catalog import query, r6
from rowscope.plans.queries_detect import (COPOD_SQL, EMB_LONG, EMB_SRC, ROUND_METRICS, emb_matrix,
                                           inne_sql, lof_sql, metrics_sql)

THREE = ["COPOD", "INNE", "LOF"]

SCORES3_SQL = f"""{EMB_LONG}, {COPOD_SQL}, {EMB_SRC}, {inne_sql()}, {lof_sql()},
sc AS (SELECT 'COPOD' AS algo, row_id, score, y FROM copod
       UNION ALL SELECT 'INNE', row_id, score, y FROM inne
       UNION ALL SELECT 'LOF', lof.row_id, lof.score, src.y FROM lof JOIN src USING (row_id)),
thr2 AS (SELECT algo, quantile_cont(score, 0.98) AS t2 FROM sc GROUP BY algo),
ens AS (SELECT row_id, CAST(sum(CASE WHEN score >= t2 THEN 1 ELSE 0 END) AS BIGINT) AS votes FROM sc
        JOIN thr2 USING (algo) GROUP BY row_id)"""


def three(spark, sf):
    # LOF with the "off" PCA preset (a reference option) keeps an exact SQL oracle
    scorers = {**B.SCORERS, "LOF": lambda fm, train=None: B.lof_with_preset(fm, "off")}
    # the tables made of it have no status: two detectors of three would look like a whole result
    return B.run_benchmark(emb_matrix(spark, sf), THREE, scorers=scorers, failures="raise")


@query("benchmark_leaderboard", f"""
WITH {SCORES3_SQL}, {metrics_sql("sc")}
SELECT algo, {ROUND_METRICS} FROM metrics""")
def _d11(spark, sf):
    res = three(spark, sf)
    return r6(res.board.select("algo", "precision", "recall", "f1", "pr_auc", "roc_auc"))


@query("benchmark_best", f"""
WITH {SCORES3_SQL}, {metrics_sql("sc")}
SELECT algo AS best_algo FROM metrics ORDER BY coalesce(pr_auc, -1) DESC, algo LIMIT 1""")
def _o6(spark, sf):
    return three(spark, sf).best


@query("top_scored", f"""
WITH {EMB_LONG}, {COPOD_SQL}
SELECT row_id, round(score, 6) AS score FROM copod ORDER BY score DESC, row_id LIMIT 5""")
def _o5(spark, sf):
    scores = B.SCORERS["COPOD"](emb_matrix(spark, sf)).withColumn("algo", F.lit("COPOD"))
    return r6(B.top_rows(scores, "COPOD", 5))


@query("pseudo_labels", f"""
WITH {SCORES3_SQL}
SELECT row_id, votes, CAST(votes >= 2 AS INTEGER) AS ensemble FROM ens""")
def _e8(spark, sf):
    res = three(spark, sf)
    return E.pseudo_labels(res.scores.drop("y"), 0.02)


@query("pseudo_evaluation", f"""
WITH {SCORES3_SQL},
pe AS (SELECT sc.algo, sc.score, CAST(ens.votes >= 2 AS INTEGER) AS y FROM sc JOIN ens USING (row_id)),
{metrics_sql("pe")}
SELECT algo, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       round(pr_auc, 4) AS pr_auc FROM metrics""")
def _e9(spark, sf):
    res = three(spark, sf)
    return E.pseudo_evaluation(res.scores.drop("y"), 0.02)


@query("merged_scores", f"""
WITH {SCORES3_SQL}
SELECT row_id, round(max(CASE WHEN algo = 'COPOD' THEN score END), 6) AS COPOD,
       round(max(CASE WHEN algo = 'INNE' THEN score END), 6) AS INNE,
       round(max(CASE WHEN algo = 'LOF' THEN score END), 6) AS LOF,
       any_value(CAST(votes >= 2 AS INTEGER)) AS ensemble
FROM sc JOIN ens USING (row_id) GROUP BY row_id""")
def _e10(spark, sf):
    res = three(spark, sf)
    return r6(E.merged_scores(res.scores.drop("y"), THREE, 0.02))


@query("ocsvm_nu_share", "SELECT count(*) AS n_rows, true AS share_near_nu FROM embeddings")
def _ocsvm_nu_share(spark, sf):
    """At the optimum a share nu = 0.05 of all rows scores above 0."""
    share = F.avg((F.col("score") > 0).cast("double"))
    return ocsvm_scores(M.standard_scale(emb_matrix(spark, sf)), nu=0.05).agg(
        F.count("*").alias("n_rows"), (F.abs(share - 0.05) <= 0.01).alias("share_near_nu"))


@query("ocsvm_scores")
def _d5(spark, sf):
    return ocsvm_scores(M.standard_scale(emb_matrix(spark, sf)))


@query("autoencoder_scores")
def _d7(spark, sf):
    return autoencoder_scores(emb_matrix(spark, sf), preset="simple")


@query("autoencoder_deep_scores")
def _d6_deep(spark, sf):
    """PCA, batch normalisation, absolute error, plateau schedule, early stopping."""
    return autoencoder_scores(emb_matrix(spark, sf), preset="deep")


@query("benchmark_all_detectors")
def _d11_all(spark, sf):
    res = B.run_benchmark(emb_matrix(spark, sf), "all", orient=True)
    return res.board.select("algo", "status", "precision", "recall", "f1", "pr_auc", "roc_auc", "flipped")


@query("autoencoder_trained_on_normal")
def _d6(spark, sf):
    """D6 flow: the scaler and the network are fitted on the normal split only (the
    reference's anomaly-free files; here rows whose label is not the anomaly class),
    every row is scored, and scores are smoothed in row order (width 11)."""
    fm = emb_matrix(spark, sf)
    scores = autoencoder_scores(fm, train=fm.where(F.col("y") == 0), preset="deep")
    return B.smooth_scores(scores, fm, 11)
