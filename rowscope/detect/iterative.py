"""Data-parallel iterative fitting by parameter averaging (used by D5, D6, D7).

Per round the parameters are broadcast; every partition runs its mini-batches in
``mapInPandas`` over blocks of ``block_rows`` rows (whatever the Arrow batch size is) and
emits its parameters in chunks. The chunks are averaged on the executors in two grouped
steps (per chunk and a part of the partitions, then per chunk), so the driver receives
one set of parameters and four sums per round, independent of the number of partitions.
The input is checkpointed once so that every round reads the same rows.

With ``val_fraction`` 0 all rows train and all rounds run. Otherwise validation rows are
chosen by a hash of ``row_id``, a plateau of their loss lowers the learning rate, and the
best parameters are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect.features import spread
from rowscope.session import reliable_checkpoint

Params = dict[str, np.ndarray]
CHUNK = 4096
_STATS = "."  # not a parameter name
_PART = "name string, chunk int, part int, w double, v array<double>"


def _chunks(name: str, values: np.ndarray, part: int, w: float):
    flat = np.asarray(values, float).ravel()
    for i in range(0, len(flat), CHUNK):
        yield name, i // CHUNK, part, w, flat[i:i + CHUNK] * w


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    return pd.DataFrame([(first["name"], first["chunk"], 0, pdf["w"].sum(), np.sum(np.stack(pdf["v"].to_numpy()), axis=0))],
                        columns=["name", "chunk", "part", "w", "v"])


def average_fit(data: DataFrame, params: Params,
                local_step: Callable[[Params, np.ndarray, np.random.Generator, dict], tuple[Params, float]],
                rounds: int = 20, state: dict | None = None, local_epochs: int = 1, val_fraction: float = 0.0,
                patience: int | None = None, plateau: tuple[float, int] | None = None, seed: int = 42,
                loss_fn: Callable[[Params, np.ndarray], np.ndarray] | None = None,
                block_rows: int = 4096) -> tuple[Params, list[dict]]:
    """Fit ``params`` on ``data(row_id, x)``. ``local_step(params, rows, rng, state)`` trains on one
    block and returns (params, summed loss); ``state["lr_scale"]`` is the plateau schedule's factor.
    ``loss_fn`` gives per-row losses of validation rows."""
    spark = data.sparkSession
    sc = spark.sparkContext
    tag = F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed)), F.lit(1000)) < int(val_fraction * 1000)
    data = reliable_checkpoint(spread(data.select("row_id", "x").withColumn("_val", tag)))
    history: list[dict] = []
    best, best_loss, bad = params, np.inf, 0
    state = dict(state or {}) | {"lr_scale": 1.0}
    for r in range(rounds):
        bc = sc.broadcast((params, state, r))

        def run(batches):
            from pyspark import TaskContext

            p, st, rnd = bc.value
            pid = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, rnd, pid])
            sums = np.zeros(4)  # rows, loss, validation rows, validation loss
            held: list[np.ndarray] = []

            def train(p, X):
                for _ in range(local_epochs):
                    p, loss = local_step(p, X, rng, dict(st))
                sums[0] += len(X)
                sums[1] += loss
                return p

            for pdf in batches:
                if pdf.empty:
                    continue
                X = np.stack(pdf["x"].to_numpy()).astype(float)
                val = pdf["_val"].to_numpy().astype(bool)
                if val.any():
                    sums[2] += val.sum()
                    sums[3] += float(loss_fn(bc.value[0], X[val]).sum())
                held.append(X[~val])
                while sum(map(len, held)) >= block_rows:
                    both = np.concatenate(held)
                    p = train(p, both[:block_rows])
                    held = [both[block_rows:]]
            rest = np.concatenate(held) if held else np.zeros((0, 0))
            if len(rest):
                p = train(p, rest)
            rows = list(_chunks(_STATS, sums, pid, 1.0))
            if sums[0]:
                for name, value in p.items():
                    rows += _chunks(name, value, pid, float(sums[0]))
            yield pd.DataFrame(rows, columns=["name", "chunk", "part", "w", "v"])

        width = max(1, math.isqrt(data.rdd.getNumPartitions()))
        out = (data.mapInPandas(run, _PART).withColumn("part", F.col("part") % width)
               .groupBy("name", "chunk", "part").applyInPandas(_summed, _PART)
               .groupBy("name", "chunk").applyInPandas(_summed, _PART).toPandas())
        bc.unpersist()
        n, loss, vn, vloss = np.asarray(out[out["name"] == _STATS]["v"].iloc[0])
        if n == 0:
            break
        new = {}
        for name, shape in ((k, v.shape) for k, v in params.items()):
            own = out[out["name"] == name].sort_values("chunk")
            new[name] = np.concatenate([np.asarray(v) / w for v, w in zip(own["v"], own["w"], strict=True)]).reshape(shape)
        began, params = params, new
        history.append({"round": r, "train_loss": loss / n, "val_loss": vloss / vn if vn else None})
        if not vn:
            best = params
            continue
        # the validation loss is that of the parameters the round began with
        if vloss / vn < best_loss - 1e-12:
            best, best_loss, bad = began, vloss / vn, 0
        else:
            bad += 1
            if plateau and bad % plateau[1] == 0:
                state["lr_scale"] *= plateau[0]
            if patience and bad >= patience:
                break
    return best, history
