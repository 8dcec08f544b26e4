"""Scoring evaluation.

Input is a long score table ``(row_id, algo, score[, y])``. All detectors are
evaluated in one pass: every aggregate is grouped by ``algo``.

* E1: threshold = (1 - top_q) quantile of the scores (exact, linear), positive = ``>=``.
* E2: precision / recall / F1, 0 when undefined.
* E3: average precision Σ (R_i − R_{i−1}) P_i over distinct scores (tied scores are
  one step) — the step sum, not a trapezoid.
* E4: ROC-AUC from the rank sum with mid-ranks.
* E5-E7: curve points from the same cumulative table.

The cumulative table is per (algo, distinct score): counts shrink map-side and
the running sums use the range-partitioned prefix sum, so no algorithm's scores are ever
ordered inside one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.operators.aggregate import percentiles
from rowscope.plans.ordering import prefix_sums
from rowscope.session import reliable_checkpoint


def _dbl(c):
    return F.col(c).cast("double")


def cumulative(scores: DataFrame, algo: str = "algo", score: str = "score", y: str | None = "y") -> DataFrame:
    """Per (algo, distinct score), descending: c, cc (rows scoring at least s), n (all rows of the algorithm)
    and, with labels, pos, neg, running tp, fp and their totals p, nn. Checkpointed (it is read several times)."""
    base = scores.where(F.col(score).isNotNull())
    aggs = [F.count(F.lit(1)).alias("c")]
    names = {"cum_c": "cc", "sum_c": "n"}
    if y is not None:
        aggs = [F.coalesce(F.sum(F.col(y)), F.lit(0)).cast("long").alias("pos"),
                F.coalesce(F.sum(1 - F.col(y)), F.lit(0)).cast("long").alias("neg")] + aggs
        names = {"cum_pos": "tp", "cum_neg": "fp", "sum_pos": "p", "sum_neg": "nn"} | names
    ds = base.groupBy(algo, score).agg(*aggs)
    sums = ["c"] if y is None else ["pos", "neg", "c"]
    cum = prefix_sums(ds, score, sums, [algo], descending=True, total_prefix="sum_")
    return reliable_checkpoint(cum.withColumnsRenamed(names))


def _quantiles(cum: DataFrame, q: float, algo: str = "algo", score: str = "score") -> DataFrame:
    """(algo, threshold): exact linear-interpolation quantile per algorithm from the cumulative table;
    a distinct score covers ascending ranks [n − cc, n − cc + c − 1]."""
    pos = (F.col("n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    first = F.col("n") - F.col("cc")
    last = first + F.col("c") - 1
    at = cum.groupBy(algo).agg(
        F.max(F.when((first <= lo) & (last >= lo), F.col(score))).cast("double").alias("_lo"),
        F.max(F.when((first <= hi) & (last >= hi), F.col(score))).cast("double").alias("_hi"),
        F.max(pos - F.floor(pos)).alias("_part"))
    return at.select(algo, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("threshold"))


def _with_threshold(rows: DataFrame, thr: DataFrame, algo: str) -> DataFrame:
    """Rows with their algorithm's threshold (one row for each algorithm), in the rows' own column order.
    Joined by key, all rows of an algorithm would be sorted in one task."""
    return rows.join(F.broadcast(thr), algo, "left").select(*rows.columns, "threshold")


def thresholds(scores: DataFrame, q: float = 0.98, algo: str = "algo", score: str = "score") -> DataFrame:
    """Per-algorithm quantile threshold (one row per detector)."""
    return _quantiles(cumulative(scores, algo, score, None), q, algo, score)


def flags(scores: DataFrame, q: float = 0.98, algo: str = "algo", score: str = "score") -> DataFrame:
    """Rows with ``pred = score >= threshold``."""
    told = _with_threshold(scores, thresholds(scores, q, algo, score), algo)
    return told.withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))


def metrics(scores: DataFrame, top_q: float = 0.02, algo: str = "algo", score: str = "score",
            y: str = "y") -> DataFrame:
    """E1-E4 per algorithm: precision, recall, f1, pr_auc, roc_auc — all from one
    cumulative table per (algo, distinct score).

    Threshold: exact quantile read off the running counts; TP/FP at the threshold
    are sums over distinct scores ``>=`` it; AP is Σ pos·precision / P; ROC-AUC uses
    mid-ranks among the labelled rows, Σ pos·midrank = (P+N)·P − Σ pos·(tp + fp −
    (pos + neg + 1)/2). Rows without a label count for the threshold only.
    """
    cum = cumulative(scores, algo, score, y)
    hit = F.col(score) >= F.col("threshold")
    m = _with_threshold(cum, _quantiles(cum, round(1 - top_q, 12), algo, score), algo).groupBy(algo).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).cast("double").alias("tp_t"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).cast("double").alias("fp_t"),
        F.sum("pos").cast("double").alias("p"),
        F.sum("neg").cast("double").alias("nn"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * _dbl("tp") / (F.col("tp") + F.col("fp")))).alias("ap_sum"),
        F.sum(F.col("pos") * (F.col("tp") + F.col("fp") - (F.col("pos") + F.col("neg") + 1) / 2.0)).alias("s1"))
    prec = F.when(F.col("tp_t") + F.col("fp_t") > 0, F.col("tp_t") / (F.col("tp_t") + F.col("fp_t"))).otherwise(0.0)
    rec = F.when(F.col("p") > 0, F.col("tp_t") / F.col("p")).otherwise(0.0)
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    rank_sum = (F.col("p") + F.col("nn")) * F.col("p") - F.col("s1")
    ap = F.when(F.col("p") > 0, F.col("ap_sum") / F.col("p"))
    auc = F.when((F.col("p") > 0) & (F.col("nn") > 0),
                 (rank_sum - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("nn")))
    return m.select(algo, "precision", "recall", f1.alias("f1"), ap.alias("pr_auc"), auc.alias("roc_auc"))


def leaderboard(scores: DataFrame, top_q: float = 0.02, seconds: DataFrame | None = None,
                algo: str = "algo") -> DataFrame:
    """``algo, [seconds,] precision, recall, f1, pr_auc, roc_auc`` best AP first."""
    m = metrics(scores, top_q, algo)
    if seconds is not None:
        m = m.join(F.broadcast(seconds), algo, "left")
    return m.orderBy(F.desc_nulls_last("pr_auc"), algo)


def pr_curve(scores: DataFrame, algo: str = "algo", score: str = "score", y: str = "y") -> DataFrame:
    """E5: ``(algo, threshold, precision, recall)`` per distinct score down to the first
    point of full recall, plus the closing point (precision 1, recall 0)."""
    cum = cumulative(scores, algo, score, y)
    p = cum.groupBy(algo).agg(F.max("p").alias("p")).where(F.col("p") > 0)
    pts = (cum.where(F.col("p") > 0)
           .where((F.col("tp") - F.col("pos") < F.col("p")) & (F.col("pos") + F.col("neg") > 0))
           .select(algo, F.col(score).cast("double").alias("threshold"),
                   (_dbl("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                   (_dbl("tp") / F.col("p")).alias("recall")))
    close = p.select(algo, F.lit(None).cast("double").alias("threshold"),
                     F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(close)


def f1_curve(pr: DataFrame, algo: str = "algo") -> tuple[DataFrame, DataFrame]:
    """F1 along the PR curve (``2pr/(p+r+1e-9)``) and its maximum per algorithm."""
    pts = pr.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                        / (F.col("precision") + F.col("recall") + 1e-9))
    best = pts.groupBy(algo).agg(F.max("f1").alias("max_f1"))
    return pts, best


def roc_curve(scores: DataFrame, algo: str = "algo", score: str = "score",
              y: str = "y") -> tuple[DataFrame, DataFrame]:
    """ROC points ``(algo, threshold, fpr, tpr)`` with the (0, 0) start, and the
    trapezoid AUC per algorithm (each step's area needs only its own counts)."""
    cum = cumulative(scores, algo, score, y)
    c = cum.where((F.col("p") > 0) & (F.col("nn") > 0))
    pn = c.select(algo).distinct()
    pts = c.select(algo, F.col(score).cast("double").alias("threshold"),
                   (_dbl("fp") / F.col("nn")).alias("fpr"), (_dbl("tp") / F.col("p")).alias("tpr"))
    start = pn.select(algo, F.lit(None).cast("double").alias("threshold"),
                      F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    area = (F.col("neg") / F.col("nn")) * (2 * F.col("tp") - F.col("pos")) / (2.0 * F.col("p"))
    auc = c.groupBy(algo).agg(F.sum(area).alias("roc_auc_trapezoid"))
    return pts.unionByName(start), auc


def pseudo_labels(scores: DataFrame, top_q: float = 0.02, key: str = "row_id",
                  algo: str = "algo", score: str = "score") -> DataFrame:
    """Per-algorithm top ``top_q`` flags; ``ensemble = votes >= (k+1) div 2``.

    Returns ``(row_id, votes, ensemble)``; k = number of algorithms (the rows of
    the threshold table).
    """
    thr = thresholds(scores, round(1 - top_q, 12), algo, score)
    k = thr.count()
    pred = (F.col(score) >= F.col("threshold")).cast("int")
    return (_with_threshold(scores, thr, algo).withColumn("pred", pred).groupBy(key).agg(F.sum("pred").alias("votes"))
            .withColumn("ensemble", (F.col("votes") >= (k + 1) // 2).cast("int")))


def pseudo_evaluation(scores: DataFrame, top_q: float = 0.02, key: str = "row_id",
                      algo: str = "algo", score: str = "score", digits: int = 4) -> DataFrame:
    """Every algorithm against the ensemble pseudo-labels; 4-digit rounding."""
    ens = pseudo_labels(scores, top_q, key, algo, score).select(key, F.col("ensemble").alias("y"))
    m = metrics(scores.drop("y").join(ens, key), top_q, algo, score, "y")
    return m.select(algo, *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1", "pr_auc")])


def merged_scores(scores: DataFrame, algos: Sequence[str], top_q: float = 0.02, key: str = "row_id",
                  algo: str = "algo", score: str = "score") -> DataFrame:
    """Wide table, one score column per algorithm plus ``ensemble``."""
    wide = scores.groupBy(key).pivot(algo, list(algos)).agg(F.first(score))
    ens = pseudo_labels(scores, top_q, key, algo, score).select(key, "ensemble")
    return wide.join(ens, key)


def self_reference(scores: DataFrame, top_q: float = 0.02, algo: str = "algo",
                   score: str = "score") -> DataFrame:
    """E11 (documented only): labels = own top ``top_q``; AP is 1.0 by construction."""
    fl = flags(scores, round(1 - top_q, 12), algo, score).withColumn("y", F.col("pred")).drop("threshold", "pred")
    return metrics(fl, top_q, algo, score, "y")


def score_thresholds(scores: DataFrame, score: str = "score", q: float = 0.995, k: float = 3.0,
                     group: Sequence[str] = ()) -> DataFrame:
    """Quantile, mean + k·std (population), median + k·1.4826·MAD (+1e-12).

    Grouped: per-group tables joined on the group keys. Ungrouped: the quantile
    and median are two numbers, applied as literals to one aggregate pass.
    """
    group = list(group)
    base = scores.select(*group, F.col(score).cast("double").alias("_s")).where(F.col("_s").isNotNull())
    if group:
        qs = percentiles(base, F.col("_s"), [q, 0.5], group, names=["thr_quantile", "_med"])
        mom = base.groupBy(*group).agg((F.avg("_s") + k * F.stddev_pop("_s")).alias("thr_std"))
        dev = base.join(qs.select(*group, "_med"), group)
        mad = percentiles(dev.select(*group, F.abs(F.col("_s") - F.col("_med")).alias("_d")), F.col("_d"),
                          [0.5], group, names=["_mad"])
        out = qs.join(mom, group).join(mad, group)
        return out.select(*group, "thr_quantile", "thr_std",
                          (F.col("_med") + k * 1.4826 * (F.col("_mad") + 1e-12)).alias("thr_mad"))
    qv, med = percentiles(base, F.col("_s"), [q, 0.5], names=["a", "b"]).first()
    mad = percentiles(base.select(F.abs(F.col("_s") - F.lit(med)).alias("_d")), F.col("_d"), [0.5],
                      names=["m"]).first()[0] if med is not None else None
    thr_mad = None if med is None else med + k * 1.4826 * ((mad or 0.0) + 1e-12)
    return base.agg(F.lit(qv).cast("double").alias("thr_quantile"),
                    (F.avg("_s") + k * F.stddev_pop("_s")).alias("thr_std"),
                    F.lit(thr_mad).cast("double").alias("thr_mad"))


def pot_threshold(scores: DataFrame, score: str = "score", base_q: float = 0.98,
                  risk: float = 1e-3, fallback_q: float = 0.995) -> DataFrame:
    """Peaks over threshold. Excesses over the ``base_q`` quantile t get a
    generalized Pareto fit by the method of moments (declared deviation from a
    likelihood fit); the threshold is t plus the fit's 1 − ``risk`` quantile,
    ``t + σ/ξ(risk^(−ξ) − 1)``. Falls back to the ``fallback_q`` quantile only when
    the fit is impossible (no spread among the excesses). The two quantiles are
    literals; the moments are one aggregate pass.
    """
    base = scores.select(F.col(score).cast("double").alias("_s")).where(F.col("_s").isNotNull())
    t, fb = percentiles(base, F.col("_s"), [base_q, fallback_q], names=["t", "fb"]).first()
    t_l = F.lit(t).cast("double")
    ex = F.when(F.col("_s") > t_l, F.col("_s") - t_l)
    d = base.agg(F.count(F.lit(1)).alias("_n"), F.count(ex).alias("_nt"), F.avg(ex).alias("_m"),
                 F.var_pop(ex).alias("_v"))
    xi = 0.5 * (1 - F.col("_m") * F.col("_m") / F.col("_v"))
    sigma = 0.5 * F.col("_m") * (F.col("_m") * F.col("_m") / F.col("_v") + 1)
    d = d.withColumn("xi", xi).withColumn("sigma", sigma)
    r = F.lit(float(risk))
    z = F.when(F.abs(F.col("xi")) < 1e-9, t_l - F.col("sigma") * F.log(r)) \
        .otherwise(t_l + F.col("sigma") / F.col("xi") * (F.pow(r, -F.col("xi")) - 1))
    ok = F.coalesce((F.col("_v") > 0) & (F.col("sigma") > 0), F.lit(False))
    return d.select(F.when(ok, z).otherwise(F.lit(fb).cast("double")).alias("thr_pot"),
                    F.when(ok, F.lit("gpd_moments")).otherwise(F.lit("quantile_fallback")).alias("method"),
                    "xi", "sigma")


#: Cuts of the bracket in one pass of the likelihood fit, and passes: the bracket ends 64⁶ times smaller.
LIKELIHOOD_CUTS, LIKELIHOOD_PASSES = 64, 6


def pot_likelihood(scores: DataFrame, score: str = "score", base_q: float = 0.98, risk: float = 1e-3,
                   fallback_q: float = 0.995) -> DataFrame:
    """E13 by likelihood: the generalized Pareto tail of the excesses over the ``base_q`` quantile t.

    With θ = ξ/σ the best ξ for a given θ is the mean of ln(1 + θy), so the likelihood has one
    parameter left; its slope has the sign of (1 + ξ)·mean(1/(1 + θy)) − 1. Near θ = 0 that sign is
    known from the second moment: it tells on which side the maximum lies (ξ = 0 exactly if neither).
    The maximum next to 0 on that side is found by cutting the bracket into 64 parts, six times; one
    pass sums ln(1 + θy) and 1/(1 + θy) for all cuts with partial aggregation. Only those 64 sums reach
    the driver; the excesses are written once, y is divided by its mean.

    One row: thr_pot = t + σ/ξ(risk^(−ξ) − 1), method, xi, sigma, n_excess. ``gpd_likelihood`` is the
    fit. A tail without spread, or a short one whose likelihood only grows to its bound (no maximum
    inside), gives ``quantile_fallback``: the ``fallback_q`` quantile, xi and sigma null. Null scores are
    left out; an empty table gives one row with a null threshold.
    """
    base = scores.select(F.col(score).cast("double").alias("_s")).where(F.col("_s").isNotNull())
    row = percentiles(base, F.col("_s"), [base_q, fallback_q], names=["t", "fb"]).first()
    t, fb = row if row else (None, None)
    over = reliable_checkpoint(base.where(F.col("_s") > F.lit(t).cast("double")).select((F.col("_s") - F.lit(t).cast("double")).alias("y")))
    n, mean, square, top = over.agg(F.count("y"), F.avg("y"), F.avg(F.col("y") * F.col("y")), F.max("y")).first()
    xi = sigma = None
    if n and square > mean * mean * (1 + 1e-12):
        side = square / (2 * mean * mean) - 1
        if abs(side) < 1e-12:
            xi, sigma = 0.0, mean
        else:
            scaled = over.select((F.col("y") / mean).alias("y"))

            def theta(u: float) -> float:
                return u / (1 - u) if side > 0 else -u * mean / top

            lo, width = 0.0, 1.0
            for step in range(LIKELIHOOD_PASSES):
                cuts = [lo + width * i / LIKELIHOOD_CUTS for i in range(1, LIKELIHOOD_CUTS)]
                x = F.col("th") * F.col("y") + 1.0
                sums = (scaled.select("y", F.posexplode(F.array(*[F.lit(theta(u)) for u in cuts])).alias("i", "th"))
                        .groupBy("i").agg(F.avg(F.log(x)).alias("k"), F.avg(1.0 / x).alias("u")))
                slope = {r["i"]: ((1 + r["k"]) * r["u"] - 1) * (1 if side > 0 else -1) for r in sums.collect()}
                at = next((i for i in range(len(cuts)) if slope[i] <= 0), None)
                if at is None and step == 0 and side < 0:
                    break  # the likelihood grows all the way to its bound
                lo, width = lo + width * (len(cuts) if at is None else at) / LIKELIHOOD_CUTS, width / LIKELIHOOD_CUTS
            else:
                th = theta(lo + width / 2)
                xi = scaled.agg(F.avg(F.log(F.lit(th) * F.col("y") + 1.0))).first()[0]
                sigma = xi / th * mean
    if xi is None:
        thr, method = fb, "quantile_fallback"
    else:
        thr = t - sigma * math.log(risk) if abs(xi) < 1e-9 else t + sigma / xi * (risk ** -xi - 1)
        method = "gpd_likelihood"
    return scores.sparkSession.createDataFrame(
        [(thr, method, xi, sigma, n)], "thr_pot double, method string, xi double, sigma double, n_excess long")
