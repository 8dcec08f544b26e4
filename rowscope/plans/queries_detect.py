"""Registered queries for feature preparation, detectors and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscope.detect import features as M
from rowscope.detect.copod import copod_scores
from rowscope.operators import evaluate as E
from rowscope.plans.catalog import query, r6, t

# ---------------------------------------------------------------- SQL pieces

EMB_LONG = """emb_long AS (
  SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y,
         CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS j,
         CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""

COPOD_SQL = """copod_cnt AS (SELECT j, v, count(*) AS c FROM emb_long GROUP BY j, v),
copod_cum AS (SELECT j, v, c, sum(c) OVER (PARTITION BY j ORDER BY v) AS le FROM copod_cnt),
copod_j AS (SELECT j, count(*) AS n, skewness(v) AS sk FROM emb_long GROUP BY j),
copod_lr AS (SELECT j, v, -ln(le / n) AS l, -ln((n - le + c) / n) AS r, sign(sk) AS s
             FROM copod_cum JOIN copod_j USING (j)),
copod_o AS (SELECT j, v, greatest(CASE WHEN s < 0 THEN l WHEN s > 0 THEN r ELSE l + r END, (l + r) / 2) AS o
            FROM copod_lr),
copod AS (SELECT row_id, any_value(y) AS y, sum(o) AS score FROM emb_long JOIN copod_o USING (j, v)
          GROUP BY row_id)"""


def metrics_sql(src: str, q: float = 0.98) -> str:
    """CTEs ending in ``metrics(algo, precision, recall, f1, pr_auc, roc_auc)`` over
    ``src(algo, score, y)``."""
    return f"""thr AS (SELECT algo, quantile_cont(score, {q}) AS t FROM {src} GROUP BY algo),
cls AS (SELECT s.algo, sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN score >= t AND y = 0 THEN 1 ELSE 0 END) AS fp,
               sum(y) AS p, sum(1 - y) AS nn
        FROM {src} s JOIN thr USING (algo) GROUP BY s.algo),
ds AS (SELECT algo, score, sum(y) AS pos, sum(1 - y) AS neg, count(*) AS c FROM {src}
       WHERE score IS NOT NULL GROUP BY algo, score),
cu AS (SELECT *, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc, sum(c) OVER w AS cc,
              sum(c) OVER (PARTITION BY algo) AS nall
       FROM ds WINDOW w AS (PARTITION BY algo ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rk AS (SELECT algo, sum(pos * tpc / (tpc + fpc)) AS ap_sum, sum(pos * ((nall - cc) + (c + 1) / 2.0)) AS rank_sum
       FROM cu GROUP BY algo),
mm AS (SELECT cls.algo, CAST(p AS DOUBLE) AS p, CAST(nn AS DOUBLE) AS nn,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN p > 0 THEN tp / p ELSE 0.0 END AS recall, ap_sum, rank_sum
       FROM cls LEFT JOIN rk USING (algo)),
metrics AS (SELECT algo, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CASE WHEN p > 0 THEN ap_sum / p END AS pr_auc,
       CASE WHEN p > 0 AND nn > 0 THEN (rank_sum - p * (p + 1) / 2) / (p * nn) END AS roc_auc FROM mm)"""


ROUND_METRICS = ("round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
                 "round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc")

LI_SCORES_SQL = """li_scores AS (
  SELECT 'l_quantity' AS algo, l_quantity AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER) FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount, CAST(l_returnflag = 'R' AS INTEGER) FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax, CAST(l_returnflag = 'R' AS INTEGER) FROM lineitem)"""


# ---------------------------------------------------------------- Spark pieces

def emb_matrix(spark, sf):
    emb = t(spark, sf, "embeddings")
    return M.from_array(emb, "vec_id", "embedding", label=(F.col("label") == 0))


def lineitem_scores(spark, sf):
    li = t(spark, sf, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    return li.select(F.expr("stack(4, 'l_quantity', l_quantity, 'l_extendedprice', l_extendedprice, "
                            "'l_discount', l_discount, 'l_tax', l_tax) AS (algo, score)"), y)


def copod_long(spark, sf):
    fm = emb_matrix(spark, sf)
    s = copod_scores(fm)
    return s.join(fm.select("row_id", "y"), "row_id").withColumn("algo", F.lit("COPOD"))


# ---------------------------------------------------------------- queries

@query("standard_scale", f"""
WITH {EMB_LONG},
st AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM emb_long GROUP BY j)
SELECT row_id, j, round((v - m) / CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END, 6) AS v
FROM emb_long JOIN st USING (j)""")
def _m1(spark, sf):
    return r6(M.to_long(M.standard_scale(emb_matrix(spark, sf))).select("row_id", "j", "v"))


@query("robust_scale", f"""
WITH {EMB_LONG},
st AS (SELECT j, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr
       FROM emb_long GROUP BY j)
SELECT row_id, j, round((v - m) / CASE WHEN iqr = 0 OR iqr IS NULL THEN 1 ELSE iqr END, 6) AS v
FROM emb_long JOIN st USING (j)""")
def _m2(spark, sf):
    return r6(M.to_long(M.robust_scale(emb_matrix(spark, sf))).select("row_id", "j", "v"))


@query("copod_scores", f"""
WITH {EMB_LONG}, {COPOD_SQL}
SELECT row_id, round(score, 6) AS score FROM copod""")
def _d3(spark, sf):
    return r6(copod_scores(emb_matrix(spark, sf)))


@query("copod_leaderboard", f"""
WITH {EMB_LONG}, {COPOD_SQL},
sc AS (SELECT 'COPOD' AS algo, score, y FROM copod),
{metrics_sql("sc")}
SELECT algo, {ROUND_METRICS} FROM metrics""")
def _d3_board(spark, sf):
    return r6(E.leaderboard(copod_long(spark, sf)))


@query("eval_metrics", f"""
WITH {LI_SCORES_SQL}, {metrics_sql("li_scores")}
SELECT algo, {ROUND_METRICS} FROM metrics""")
def _e1_4(spark, sf):
    return r6(E.metrics(lineitem_scores(spark, sf)))


@query("eval_thresholds", f"""
WITH {LI_SCORES_SQL}
SELECT algo, round(quantile_cont(score, 0.98), 6) AS threshold FROM li_scores GROUP BY algo""")
def _e1(spark, sf):
    return r6(E.thresholds(lineitem_scores(spark, sf), 0.98))


_CUM_SQL = """ds AS (SELECT algo, score, sum(y) AS pos, sum(1 - y) AS neg FROM li_scores
       WHERE score IS NOT NULL GROUP BY algo, score),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY algo) AS p,
              sum(neg) OVER (PARTITION BY algo) AS nn
       FROM ds WINDOW w AS (PARTITION BY algo ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("pr_curve", f"""
WITH {LI_SCORES_SQL}, {_CUM_SQL}
SELECT algo, CAST(score AS DOUBLE) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall
FROM cu WHERE p > 0 AND tp - pos < p
UNION ALL SELECT DISTINCT algo, NULL, 1.0, 0.0 FROM cu WHERE p > 0""")
def _e5(spark, sf):
    return r6(E.pr_curve(lineitem_scores(spark, sf)))


@query("f1_curve_max", f"""
WITH {LI_SCORES_SQL}, {_CUM_SQL},
pts AS (SELECT algo, tp / (tp + fp) AS pr, tp / p AS rc FROM cu WHERE p > 0 AND tp - pos < p
        UNION ALL SELECT DISTINCT algo, 1.0, 0.0 FROM cu WHERE p > 0)
SELECT algo, round(max(2 * pr * rc / (pr + rc + 1e-9)), 6) AS max_f1 FROM pts GROUP BY algo""")
def _e6(spark, sf):
    _, best = E.f1_curve(E.pr_curve(lineitem_scores(spark, sf)))
    return r6(best)


@query("roc_curve", f"""
WITH {LI_SCORES_SQL}, {_CUM_SQL}
SELECT algo, CAST(score AS DOUBLE) AS threshold, round(fp / nn, 6) AS fpr, round(tp / p, 6) AS tpr
FROM cu WHERE p > 0 AND nn > 0
UNION ALL SELECT DISTINCT algo, NULL, 0.0, 0.0 FROM cu WHERE p > 0 AND nn > 0""")
def _e7(spark, sf):
    pts, _ = E.roc_curve(lineitem_scores(spark, sf))
    return r6(pts)


@query("roc_auc_trapezoid", f"""
WITH {LI_SCORES_SQL}, {_CUM_SQL}
SELECT algo, round(sum((neg / nn) * (2 * tp - pos) / (2.0 * p)), 6) AS roc_auc_trapezoid
FROM cu WHERE p > 0 AND nn > 0 GROUP BY algo""")
def _e7b(spark, sf):
    _, auc = E.roc_curve(lineitem_scores(spark, sf))
    return r6(auc)


@query("score_thresholds", """
WITH b AS (SELECT value AS s FROM events WHERE value IS NOT NULL),
m AS (SELECT quantile_cont(s, 0.995) AS q, quantile_cont(s, 0.5) AS med, avg(s) + 3 * stddev_pop(s) AS sd FROM b),
d AS (SELECT quantile_cont(abs(s - med), 0.5) AS mad FROM b, m)
SELECT round(q, 6) AS thr_quantile, round(sd, 6) AS thr_std, round(med + 3 * 1.4826 * (mad + 1e-12), 6) AS thr_mad
FROM m, d""")
def _e12(spark, sf):
    ev = t(spark, sf, "events").select(F.col("value").alias("score"))
    return r6(E.score_thresholds(ev, "score", 0.995, 3.0))


@query("pot_threshold", """
WITH b AS (SELECT value AS s FROM events WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(s, 0.98) AS t, quantile_cont(s, 0.995) AS fb FROM b),
m AS (SELECT avg(s - t) AS m, var_pop(s - t) AS v FROM b, q WHERE s > t),
f AS (SELECT 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (m * m / v + 1) AS sigma, v FROM m),
z AS (SELECT *, coalesce(v > 0 AND sigma > 0, false) AS ok FROM f, q)
SELECT round(CASE WHEN NOT ok THEN fb WHEN abs(xi) < 1e-9 THEN t - sigma * ln(1e-3)
                  ELSE t + sigma / xi * (pow(1e-3, -xi) - 1) END, 6) AS thr_pot,
       CASE WHEN ok THEN 'gpd_moments' ELSE 'quantile_fallback' END AS method, round(xi, 6) AS xi, round(sigma, 6) AS sigma
FROM z""")
def _e13(spark, sf):
    ev = t(spark, sf, "events").select(F.col("value").alias("score"))
    return r6(E.pot_threshold(ev, "score"))


@query("pot_likelihood", """
WITH RECURSIVE b AS (SELECT value AS s FROM events WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(s, 0.98) AS t, quantile_cont(s, 0.995) AS fb FROM b),
e AS (SELECT avg(s - t) AS m, avg((s - t) * (s - t)) / (2 * avg(s - t) * avg(s - t)) > 1 AS heavy, max(s - t) AS top,
             list(s - t) AS ys FROM b, q WHERE s > t),
y AS (SELECT *, list_transform(ys, lambda v: v / m) AS z FROM e),
r AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS width, 0 AS at0
      UNION ALL
      SELECT step + 1, lo + width * cell / 64, width / 64, CASE WHEN step = 0 THEN cell ELSE at0 END
      FROM (SELECT step, lo, width, at0, coalesce(list_position(list_transform(list_transform(range(1, 64),
                 lambda i: CASE WHEN heavy THEN (lo + width * i / 64) / (1 - (lo + width * i / 64)) ELSE -(lo + width * i / 64) * m / top END),
                 lambda th: ((1 + list_avg(list_transform(z, lambda v: ln(1 + th * v)))) * list_avg(list_transform(z, lambda v: 1 / (1 + th * v))) - 1)
                            * (CASE WHEN heavy THEN 1 ELSE -1 END) <= 0), true), 64) - 1 AS cell
            FROM r, y WHERE step < 6)),
h AS (SELECT CASE WHEN heavy THEN (lo + width / 2) / (1 - (lo + width / 2)) ELSE -(lo + width / 2) * m / top END AS th,
             (heavy OR at0 < 63) AS ok FROM r, y WHERE step = 6),
f AS (SELECT list_avg(list_transform(z, lambda v: ln(1 + th * v))) AS xi, th, ok, m, len(z) AS n FROM h, y)
SELECT round(CASE WHEN ok THEN t + xi / th * m / xi * (pow(1e-3, -xi) - 1) ELSE fb END, 6) AS thr_pot,
       CASE WHEN ok THEN 'gpd_likelihood' ELSE 'quantile_fallback' END AS method,
       CASE WHEN ok THEN round(xi, 6) END AS xi, CASE WHEN ok THEN round(xi / th * m, 6) END AS sigma, cast(n AS BIGINT) AS n_excess
FROM f, q""")
def _e13_likelihood(spark, sf):
    """E13 fitted by likelihood, as the pipeline's reference threshold is."""
    return r6(E.pot_likelihood(t(spark, sf, "events").select(F.col("value").alias("score")), "score"))


@query("roc_auc_partial_labels", """
WITH sc AS (SELECT d.n_chars AS score, l.quality AS y FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
thr AS (SELECT quantile_cont(score, 0.98) AS t FROM sc),
c AS (SELECT sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t AND y = 0 THEN 1 ELSE 0 END) AS fp,
             sum(y) AS p, sum(1 - y) AS nn FROM sc, thr),
ds AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM sc WHERE y IS NOT NULL GROUP BY score),
cu AS (SELECT *, sum(pos) OVER w AS tpc, sum(neg) OVER w AS fpc FROM ds
       WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT sum(pos * tpc / (tpc + fpc)) AS ap, sum(neg * (tpc - pos / 2.0)) AS area FROM cu)
SELECT 'n_chars' AS algo, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
       round(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p), 6) AS f1,
       round(ap / p, 6) AS pr_auc, round(area / (p * nn), 6) AS roc_auc FROM c, a""")
def _e4(spark, sf):
    """Labels cover only some documents: rows without one count for the threshold alone."""
    docs = t(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = t(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return r6(E.metrics(docs.join(labels, "doc_id", "left").withColumn("algo", F.lit("n_chars"))))


_GAPS_SQL = """gaps AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity AS a, nullif(l_discount, 0) AS b,
       CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END AS c FROM lineitem)"""


def _gaps(spark, sf):
    """All lineitem rows as a matrix in which two features have missing values."""
    li = t(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("a"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("b"), F.when(~(F.col("l_tax") > 0.06), F.col("l_tax")).alias("c"))
    return M.from_columns(li, "row_id", ["a", "b", "c"])


def _abc(fm):
    return r6(fm.select("row_id", *[F.col("x")[i].alias(n) for i, n in enumerate("abc")]))


@query("missing_drop", f"""
WITH {_GAPS_SQL} SELECT row_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM gaps
WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def _m7_drop(spark, sf):
    return _abc(M.missing_policy(_gaps(spark, sf), "drop"))


@query("missing_impute_median", f"""
WITH {_GAPS_SQL}, med AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb, quantile_cont(c, 0.5) AS mc FROM gaps)
SELECT row_id, round(coalesce(a, ma), 6) AS a, round(coalesce(b, mb), 6) AS b, round(coalesce(c, mc), 6) AS c FROM gaps, med""")
def _m7_impute(spark, sf):
    return _abc(M.missing_policy(_gaps(spark, sf), "impute_median"))


# ---------------------------------------------------------------- INNE

from rowscope.detect.inne import EPS as _INNE_EPS, inne_scores  # noqa: E402
from rowscope.detect.sampling import sample_sql  # noqa: E402

EMB_SRC = ("src AS (SELECT vec_id AS row_id, CAST(label = 0 AS INTEGER) AS y, "
           "CAST(embedding AS DOUBLE[]) AS x FROM embeddings)")


def inne_sql(T: int = 200, psi: int = 256) -> str:
    return f"""samp AS {sample_sql("src", T, psi)},
ipairs AS (SELECT a.tree, a.rank, b.rank AS rank2, list_distance(a.x, b.x) AS d
           FROM samp a JOIN samp b ON a.tree = b.tree AND a.rank <> b.rank),
irad AS (SELECT tree, rank, min(d) AS rd, arg_min(rank2, (d, rank2)) AS nn FROM ipairs GROUP BY tree, rank),
icen AS (SELECT r.tree, r.rank, r.rd, 1 - (r2.rd * r2.rd + {_INNE_EPS!r}) / (r.rd * r.rd + {_INNE_EPS!r}) AS ratio, s.x
         FROM irad r JOIN irad r2 ON r.tree = r2.tree AND r.nn = r2.rank
         JOIN samp s ON s.tree = r.tree AND s.rank = r.rank),
icov AS (SELECT p.row_id, c.tree, arg_min(c.ratio, (c.rd, c.rank)) AS r
         FROM src p, icen c WHERE list_distance(p.x, c.x) <= c.rd GROUP BY p.row_id, c.tree),
inne AS (SELECT src.row_id, any_value(src.y) AS y,
                (coalesce(sum(icov.r), 0) + ({T} - count(icov.r))) / {T} AS score
         FROM src LEFT JOIN icov USING (row_id) GROUP BY src.row_id)"""


@query("inne_scores", f"""
WITH {EMB_SRC}, {inne_sql()}
SELECT row_id, round(score, 6) AS score FROM inne""")
def _d4(spark, sf):
    return r6(inne_scores(emb_matrix(spark, sf)))


# ---------------------------------------------------------------- LOF

from rowscope.detect.lof import knn as _knn, lof_scores  # noqa: E402
from rowscope.detect.neighbours import hashed_knn  # noqa: E402

SCALED_SQL = """st AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM emb_long GROUP BY j),
z AS (SELECT row_id, j, (v - m) / CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END AS z
      FROM emb_long JOIN st USING (j)),
pr AS (SELECT a.row_id AS p, b.row_id AS o, sum(abs(a.z - b.z)) AS d
       FROM z a JOIN z b ON a.j = b.j AND a.row_id <> b.row_id GROUP BY a.row_id, b.row_id)"""


def lof_sql(k: int = 75) -> str:
    return f"""{SCALED_SQL},
knn AS (SELECT p, o, d FROM pr QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, o) <= {k}),
kd AS (SELECT p AS o, max(d) AS kdist FROM knn GROUP BY p),
lrd AS (SELECT p, 1 / (avg(greatest(kdist, d)) + 1e-10) AS lrd FROM knn JOIN kd USING (o) GROUP BY p),
lof AS (SELECT knn.p AS row_id, avg(l2.lrd) / any_value(l1.lrd) AS score
        FROM knn JOIN lrd l2 ON knn.o = l2.p JOIN lrd l1 ON knn.p = l1.p GROUP BY knn.p)"""


@query("knn_manhattan", f"""
WITH {EMB_LONG}, {SCALED_SQL}
SELECT p AS row_id, o AS nbr_id, round(d, 6) AS dist,
       CAST(row_number() OVER (PARTITION BY p ORDER BY d, o) AS INTEGER) AS rank
FROM pr QUALIFY rank <= 10""")
def _j4(spark, sf):
    fm = M.standard_scale(emb_matrix(spark, sf))
    return r6(_knn(fm, 10, "manhattan", block_rows=128))


@query("knn_hashed", """
SELECT 'hashed' AS method, count(*) AS n_rows, 10 AS least_neighbours, CAST(0 AS BIGINT) AS wrong_distances, true AS recall_reached
FROM embeddings""")
def _j4_hashed(spark, sf):
    """Neighbours from projection tables: every distance exact, the measured recall confirmed against all pairs."""
    fm = M.standard_scale(emb_matrix(spark, sf))
    near = hashed_knn(fm, 10, "manhattan", recall=0.95, cell_rows=64)
    exact = _knn(fm, 10, "manhattan").select("row_id", "nbr_id", F.col("dist").alias("true_dist"))
    x = fm.select("row_id", "x")
    told = near.table.join(x, "row_id").join(x.select(F.col("row_id").alias("nbr_id"), F.col("x").alias("y")), "nbr_id")
    gap = F.aggregate(F.zip_with("x", "y", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, d: s + d)
    per_row = told.groupBy("row_id").agg(F.count("*").cast("int").alias("c"), F.count_if(F.abs(gap - F.col("dist")) > 1e-6).alias("w"))
    hits = exact.join(near.table.select("row_id", "nbr_id", F.lit(1).alias("hit")), ["row_id", "nbr_id"], "left").groupBy("row_id").agg(
        F.count("hit").alias("hits"), F.count("*").alias("asked"))
    return per_row.join(hits, "row_id").agg(
        F.lit(near.method).alias("method"), F.count("*").alias("n_rows"), F.min("c").alias("least_neighbours"),
        F.sum("w").alias("wrong_distances"), (F.sum("hits") >= 0.9 * F.sum("asked")).alias("recall_reached"))


@query("lof_hashed", """
SELECT 'hashed' AS method, count(*) AS n_rows, true AS recall_reached, true AS scores_agree FROM embeddings""")
def _d2_hashed(spark, sf):
    """LOF over hashed neighbours: its scores stay within a tenth of the exact ones for nine rows of ten."""
    fm = M.standard_scale(emb_matrix(spark, sf))
    hashed = lof_scores(fm, k=20, method="hashed", cell_rows=128, recall=0.95)
    exact = lof_scores(fm, k=20).select("row_id", F.col("score").alias("exact"))
    return hashed.join(exact, "row_id").agg(
        F.first("method").alias("method"), F.count("*").alias("n_rows"), (F.min("recall") >= 0.9).alias("recall_reached"),
        (F.avg((F.abs(F.col("score") / F.col("exact") - 1) < 0.1).cast("int")) >= 0.9).alias("scores_agree"))


@query("lof_scores", f"""
WITH {EMB_LONG}, {lof_sql()}
SELECT row_id, round(score, 6) AS score FROM lof""")
def _d2(spark, sf):
    return r6(lof_scores(M.standard_scale(emb_matrix(spark, sf)), k=75))


# ---------------------------------------------------------------- isolation forest (rows-only check)

from rowscope.detect.iforest import iforest_scores  # noqa: E402


@query("iforest_scores")
def _d1(spark, sf):
    """Factory setting: 300 trees, sample auto, ndim 1, depth scoring."""
    return iforest_scores(emb_matrix(spark, sf), n_trees=300, sample_size="auto", ndim=1, metric="depth")


@query("eif_density_scores")
def _d1b(spark, sf):
    """Pipeline default: 900 trees, ndim 1, sample 128, density scoring."""
    return iforest_scores(emb_matrix(spark, sf), n_trees=900, sample_size=128, ndim=1, metric="density")


@query("eif_hyperplane_scores")
def _d1x(spark, sf):
    """run_algo default: 500 trees, ndim 2, depth scoring, on standard-scaled input."""
    return iforest_scores(M.standard_scale(emb_matrix(spark, sf)), n_trees=500, ndim=2, metric="depth")


@query("eif_run_alone_scores")
def _d1_alone(spark, sf):
    """run_algo default with all its options: 500 trees, ndim 2, kurtosis-weighted splits, range penalty."""
    return iforest_scores(M.standard_scale(emb_matrix(spark, sf)), n_trees=500, ndim=2, metric="depth",
                          weigh_by_kurtosis=True, penalize_range=True)


@query("eif_run_alone_properties", """
SELECT count(*) + count(CASE WHEN vec_id % 50 = 7 THEN 1 END) AS n_rows, count(CASE WHEN vec_id % 50 = 7 THEN 1 END) AS n_planted,
       true AS in_unit_range, true AS penalty_never_lowers, true AS penalty_acts, true AS planted_found FROM embeddings""")
def _d1_properties(spark, sf):
    """All embeddings and, planted beside them, one in 50 again at six times its length: every row has a score in
    (0, 1], the range penalty lowers no score of the same forest, and the planted rows are ranked first (AP ≥ 0.9)."""
    from rowscope.detect import iforest
    from rowscope.session import reliable_checkpoint

    fm = emb_matrix(spark, sf).select("row_id", "x", F.lit(0).alias("y"))
    far = fm.where("row_id % 50 = 7").select((-F.col("row_id") - 1).alias("row_id"), F.transform("x", lambda v: v * 6).alias("x"),
                                             F.lit(1).alias("y"))
    both = fm.unionByName(far)
    model, psi = iforest.fit(fm, 200, 256, 2, weigh_by_kurtosis=True)
    model = reliable_checkpoint(model)
    plain = iforest.score(both.select("row_id", "x"), model, psi).withColumnRenamed("score", "plain")
    out = (iforest.score(both.select("row_id", "x"), model, psi, penalize_range=True).join(plain, "row_id")
           .join(both.select("row_id", "y"), "row_id"))
    out = reliable_checkpoint(out.withColumn("algo", F.lit("EIF")))
    found = E.metrics(out.select("row_id", "algo", "score", "y")).select((F.col("pr_auc") >= 0.9).alias("planted_found"))
    facts = out.agg(F.count("*").alias("n_rows"), F.sum("y").alias("n_planted"),
                    ((F.min("score") > 0) & (F.max("score") <= 1)).alias("in_unit_range"),
                    F.min(F.col("score") >= F.col("plain")).alias("penalty_never_lowers"),
                    F.max(F.col("score") > F.col("plain")).alias("penalty_acts"))
    return facts.withColumn("_k", F.lit(0)).join(found.withColumn("_k", F.lit(0)), "_k").drop("_k")


@query("autoencoder_regularized_scores")
def _d6_regularized(spark, sf):
    """The deep network with every regulariser: dropout, activity penalty, input noise, Huber loss."""
    from rowscope.detect.autoencoder import autoencoder_scores

    return autoencoder_scores(emb_matrix(spark, sf), preset="deep", epochs=20, loss="huber", dropout=0.1, l1=1e-5, noise=0.05)


# ---------------------------------------------------------------- PCA, quantile transform, EIF grid (rows-only)

@query("pca_variance_share")
def _m4(spark, sf):
    """M4: components keeping 95 % of the variance (signs are free: rows-only check)."""
    out = M.pca(M.standard_scale(emb_matrix(spark, sf)), 0.95)
    return out.select("row_id", F.size("x").alias("k"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
                      .alias("sq_norm"))


@query("pca_fixed_dims")
def _m5(spark, sf):
    """M5/M6: 64 requested → clipped to min(n, d) − 1, whitened (signs are free: rows-only check)."""
    out = M.pca(M.standard_scale(emb_matrix(spark, sf)), 64, whiten=True)
    return out.select("row_id", F.size("x").alias("k"), "x")


@query("quantile_normal")
def _m3(spark, sf):
    return M.quantile_normal(emb_matrix(spark, sf)).select("row_id", "x")


@query("eif_grid_best")
def _d1c(spark, sf):
    """AP of all 36 settings, best first; one scoring pass for each of the six forests."""
    from rowscope.plans.benchmark import tuned_eif

    return tuned_eif(emb_matrix(spark, sf))[1]


@query("self_reference_metrics", f"""
WITH {LI_SCORES_SQL},
t0 AS (SELECT algo, quantile_cont(score, 0.98) AS t0 FROM li_scores GROUP BY algo),
sr AS (SELECT s.algo, s.score, CAST(s.score >= t0.t0 AS INTEGER) AS y FROM li_scores s JOIN t0 USING (algo)),
{metrics_sql("sr")}
SELECT algo, {ROUND_METRICS} FROM metrics""")
def _e11(spark, sf):
    """E11 documented: labels = own top 2 %, so AP is 1.0 by construction."""
    return r6(E.self_reference(lineitem_scores(spark, sf).drop("y")))
