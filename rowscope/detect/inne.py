"""INNE: isolation using nearest-neighbour ensembles (D4; Bandaragoda et al., 2018).

Per estimator: ψ sampled centres; each centre's radius is the squared distance
to its nearest other centre, and its ratio ``1 − (r(nn(c)) + ε)/(r(c) + ε)``. A
row's estimator score is the ratio of the smallest-radius ball that covers it
(squared distance ``<=`` radius), 1 when no ball covers it; the score is the
mean over estimators (larger = more anomalous).

Plan: seeded samples (``sampling.tree_samples``) → one ``applyInPandas`` group
per estimator builds its ψ×ψ distance table (ψ is a parameter) → the model
(T·ψ centres) is broadcast → ``mapInPandas`` scores Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowscope.detect.features import spread
from rowscope.detect.sampling import tree_samples

EPS = float(np.finfo(float).eps)
#: Rows that are compared with the centres of a tree at a time, whatever the Arrow batch size is.
SCORE_ROWS = 1024


def _nearest(X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distance Σ(a−b)² of every row to its nearest other row, and that row (the first of equals).

    The BLAS form names the rows that can be nearest within a rounding bound; only these distances are
    summed pair by pair, so the result equals the full table's."""
    sq = (X * X).sum(axis=1)
    approx = sq[:, None] + sq[None, :] - 2.0 * (X @ X.T)
    np.fill_diagonal(approx, np.inf)
    near = approx <= (approx.min(axis=1) + 2e-9 * (2 * sq.max() + 1.0))[:, None]
    r, c = np.nonzero(near & np.isfinite(approx))
    D = np.full(approx.shape, np.inf)
    diff = X[r] - X[c]
    D[r, c] = (diff * diff).sum(axis=1)
    return D.min(axis=1), D.argmin(axis=1)


def _covered(X: np.ndarray, sqx: np.ndarray, C: np.ndarray, rad: np.ndarray) -> np.ndarray:
    """``Σ(x−c)² <= r(c)`` for all pairs, exactly as sums pair by pair decide it.

    The BLAS form ‖x‖² + ‖c‖² − 2x·c decides every pair whose distance is
    farther than a rounding bound from the radius; the few pairs inside the bound
    are recomputed with the per-pair sum, so the result equals the exact test.
    """
    sqc = (C * C).sum(axis=1)
    approx = sqx[:, None] + sqc[None, :] - 2.0 * (X @ C.T)
    tol = 1e-9 * (sqx[:, None] + sqc[None, :] + 1.0)
    inside = approx <= rad[None, :] - tol
    unsure = np.abs(approx - rad[None, :]) <= tol
    if unsure.any():
        ri, ci = np.nonzero(unsure)
        diff = X[ri] - C[ci]
        inside[ri, ci] = (diff * diff).sum(axis=1) <= rad[ci]
    return inside


def _matrix(col: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of equally long arrays as a matrix, without a Python object for each row."""
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _fit_tree(sample: pa.Table) -> pa.Table:
    sample = sample.sort_by("rank")
    X = _matrix(sample.column("x"), sample.num_rows)
    radius, nn = _nearest(X)
    ratio = 1.0 - (radius[nn] + EPS) / (radius + EPS)
    return pa.table({"tree": sample.column("tree"), "rank": sample.column("rank"), "x": sample.column("x"),
                     "radius": pa.array(radius), "ratio": pa.array(ratio)})


def _sums(rows: np.ndarray, forest: list[tuple]) -> np.ndarray:
    """Sum over the estimators of every row's score."""
    total = np.zeros(len(rows))
    for at in range(0, len(rows), SCORE_ROWS):
        X = rows[at:at + SCORE_ROWS]
        sqx = (X * X).sum(axis=1)
        for C, rad, ratio in forest:
            cover_mask = _covered(X, sqx, C, rad)
            cover = np.where(cover_mask, rad[None, :], np.inf)
            best = cover.argmin(axis=1)
            covered = np.isfinite(cover[np.arange(len(X)), best])
            total[at:at + SCORE_ROWS] += np.where(covered, ratio[best], 1.0)
    return total


def fit(fm: DataFrame, n_estimators: int = 200, max_samples: int = 256) -> DataFrame:
    samples, _ = tree_samples(fm, n_estimators, max_samples)
    return samples.groupBy("tree").applyInArrow(
        _fit_tree, "tree int, rank int, x array<double>, radius double, ratio double")


def score(fm: DataFrame, model: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, *keep, score)`` for every row of ``fm``; map-only, so it also runs
    on a streaming DataFrame with a model fitted in batch."""
    m = model.toArrow().sort_by([("tree", "ascending"), ("rank", "ascending")])  # T·ψ rows: bounded by parameters
    X, radius, ratio = _matrix(m.column("x"), m.num_rows), m.column("radius").to_numpy(), m.column("ratio").to_numpy()
    cut = np.flatnonzero(np.diff(m.column("tree").to_numpy(), prepend=-1))
    trees = [(X[a:b], radius[a:b], ratio[a:b]) for a, b in zip(cut, [*cut[1:], m.num_rows], strict=True)]
    bc = fm.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        forest = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            total = _sums(np.stack(pdf["x"].to_numpy()).astype(float), forest)
            out = {"row_id": pdf["row_id"].to_numpy()}
            out.update({k: pdf[k] for k in keep})
            out["score"] = total / len(forest)
            yield pd.DataFrame(out)

    schema = T.StructType([T.StructField("row_id", T.LongType())] + [fm.schema[k] for k in keep]
                          + [T.StructField("score", T.DoubleType())])
    src = fm.select("row_id", "x", *keep)
    if not fm.isStreaming:
        src = spread(src)
    return src.mapInPandas(run, schema)


def inne_scores(fm: DataFrame, n_estimators: int = 200, max_samples: int = 256) -> DataFrame:
    return score(fm, fit(fm, n_estimators, max_samples))
