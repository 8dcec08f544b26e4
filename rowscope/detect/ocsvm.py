"""One-class SVM, RBF kernel (D5), **approximate** in its kernel and exact in its optimum.

The exact quadratic program does not distribute. The RBF kernel is replaced by
random Fourier features z(x) = √(2/D)·cos(Wx + b), W ~ N(0, 2γ), γ = "scale" =
1 / (d · Var(X)). The linear one-class objective
½‖w‖² + 1/(νn) Σ max(0, ρ − w·z(x)) − ρ is convex with D + 1 unknowns and minimised on all
rows by Newton steps on a hinge that is rounded within ±δ, δ shrinking to ``LEAST`` of the
spread of the margins. A step is two passes: sums of gradient and curvature (only rows within ±δ
have any), then the objective at a few step lengths. Sums are added on the executors, so the
driver holds (D + 1)² numbers whatever the number of rows or partitions.
Score = ρ − w·z(x) (larger = more anomalous); at the optimum about a share ν of the rows is
above 0 (``ocsvm_nu_share``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect.features import dims, spread, to_long
from rowscope.detect.iterative import _PART, _chunks, _summed
from rowscope.session import reliable_checkpoint

STEPS = np.array([1.0, 0.5, 0.25, 0.1, 0.04, 0.01])
LEAST = 0.005


def _features(X, W, b):
    return np.sqrt(2.0 / W.shape[1]) * np.cos(X @ W + b)


def rounded_hinge(m: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """max(0, m), quadratic within ±delta, and its slope."""
    return np.where(m >= delta, m, np.maximum(m + delta, 0) ** 2 / (4 * delta)), np.clip((m + delta) / (2 * delta), 0, 1)


def _sums(data: DataFrame, held, part_sums: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``part_sums`` of the features of every batch, added up over all rows; ``held`` broadcasts (W, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                own = part_sums(_features(np.stack(pdf["x"].to_numpy()).astype(float), *held.value))
                total = {k: total[k] + v for k, v in own.items()} if total else own
        rows = [r for name, value in total.items() for r in _chunks(name, value, TaskContext.get().partitionId(), 1.0)]
        yield pd.DataFrame(rows, columns=["name", "chunk", "part", "w", "v"])

    width = max(1, math.isqrt(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = (data.mapInPandas(run, _PART).withColumn("part", F.col("part") % width)
           .groupBy("name", "chunk", "part").applyInPandas(_summed, _PART)
           .groupBy("name", "chunk").applyInPandas(_summed, _PART).toPandas())
    return {name: np.concatenate([np.asarray(v) for v in own.sort_values("chunk")["v"]]) for name, own in out.groupby("name")}


def fit(data: DataFrame, held, nu: float, n_features: int, rounds: int = 40) -> tuple[np.ndarray, float]:
    """w and ρ of the rows of ``data(row_id, x)``; ``held`` broadcasts the random features."""
    first = _sums(data, held, lambda Z: {"n": np.array([len(Z)]), "z": Z.sum(axis=0), "zz": (Z.T @ Z).ravel()})
    if not first:
        return np.zeros(n_features), 0.0
    n = float(first["n"][0])
    mean = first["z"] / n
    second = first["zz"].reshape(n_features, n_features) / n

    def spread_of(w):
        """Standard deviation of all rows' w·z, from the moments."""
        return math.sqrt(max(float(w @ second @ w - (w @ mean) ** 2), 1e-24))

    # begin at the optimum of ν = 1, with ρ a deviation below the middle
    theta = np.append(mean, float(mean @ mean) - spread_of(mean))
    share = 1.0  # of the spread that ±δ takes
    for _ in range(rounds):
        width = spread_of(theta[:-1])
        delta = share * width

        def curvature(Z, theta=theta, delta=delta):
            m = theta[-1] - Z @ theta[:-1]
            _, slope = rounded_hinge(m, delta)
            A = np.column_stack([-Z, np.ones(len(Z))])
            near = A[np.abs(m) < delta]
            return {"g": A.T @ slope, "h": (near.T @ near).ravel()}

        s = _sums(data, held, curvature)
        ridge = np.append(np.ones(n_features), 1e-9)
        gradient = s["g"] / (nu * n) + np.append(theta[:-1], -1.0)
        hessian = s["h"].reshape(n_features + 1, -1) / (2 * delta * nu * n) + np.diag(ridge)
        step = -np.linalg.solve(hessian, gradient)
        if abs(step[-1]) > 10 * width:  # no row within ±delta: ρ has no curvature
            step *= 10 * width / abs(step[-1])
        trials = theta + np.append(0.0, STEPS)[:, None] * step

        def losses(Z, trials=trials, delta=delta):
            m = trials[:, -1] - Z @ trials[:, :-1].T
            return {"loss": rounded_hinge(m, delta)[0].sum(axis=0)}

        value = _sums(data, held, losses)["loss"] / (nu * n) + 0.5 * (trials[:, :-1] ** 2).sum(axis=1) - trials[:, -1]
        best = int(value.argmin())
        theta = trials[best]
        settled = value[0] - value[best] <= 1e-5 * abs(value[best])
        if settled and share <= LEAST:
            break
        if settled or best == 1:
            share = max(share / 2.5, LEAST)
    return theta[:-1], float(theta[-1])


def ocsvm_scores(fm: DataFrame, nu: float = 0.05, gamma: float | str = "scale", n_features: int = 256,
                 rounds: int = 40, seed: int = 42) -> DataFrame:
    """row_id, score. ``rounds`` bounds the Newton steps; an empty input gives no rows."""
    d = dims(fm)
    if gamma == "scale":
        var = to_long(fm).agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (d * var) if d and var > 0 else 1.0
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * float(gamma)), size=(d, n_features))
    b = rng.uniform(0, 2 * np.pi, size=n_features)
    data = reliable_checkpoint(spread(fm.select("row_id", "x")))
    held = fm.sparkSession.sparkContext.broadcast((W, b))
    model = fm.sparkSession.sparkContext.broadcast(fit(data, held, nu, n_features, rounds))

    def run(batches):
        w, rho = model.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float)
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "score": rho - _features(X, *held.value) @ w})

    return data.mapInPandas(run, "row_id long, score double")
