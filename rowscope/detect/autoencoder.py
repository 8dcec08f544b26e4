"""Dense autoencoder scored by reconstruction error.

A numpy MLP trained data-parallel with Adam by parameter averaging
(``iterative.average_fit``): weights, Adam moments and batch-norm statistics are averaged
after each round, so training is not step-for-step Adam and is judged by AP on planted
outliers, not by bits. The scaler (and the PCA) is fitted on the training rows only (the
anomaly-free split in the reference) and applied to the scored rows.

* ``deep`` (D6): PCA to 32 components, mirrored encoder and decoder with batch
  normalisation before each ReLU, absolute error, a tenth of the rows for validation, the
  learning rate cut on a plateau, early stopping; optionally windows of consecutive rows.
* ``simple`` (D7): small plain network, squared error, all rows train.

Regularisers (D6, off by default, passed as options): ``dropout`` after each hidden layer but the
bottleneck, ``l1`` on the bottleneck's linear output (summed, mean over the batch), ``noise`` (standard
deviation of Gaussian noise on the input, whose target stays clean), ``loss="huber"`` and
``activation`` ``elu`` or ``leaky_relu``. Masks and noise act in training only.

Score = mean squared reconstruction error per row; smoothing (W2) composes outside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect.features import apply_scaling, dims, feature_stats, pca, quantile_normal, spread
from rowscope.detect.iterative import average_fit

# The two architectures (hidden widths) and their training settings.
PRESETS = {
    "simple": {"hidden": (16, 8, 4, 8, 16), "loss": "mse", "epochs": 20, "batch": 64, "lr": 1e-3, "batch_norm": False,
               "pca": None, "val_fraction": 0.0, "patience": None, "plateau": None},
    "deep": {"hidden": (256, 128, 8, 128, 256), "loss": "mae", "epochs": 200, "batch": 256, "lr": 1e-3, "batch_norm": True,
             "pca": 32, "val_fraction": 0.1, "patience": 10, "plateau": (0.2, 5)},
}
# Adam and batch-norm constants.
B1, B2, ADAM_EPS = 0.9, 0.999, 1e-7
NORM_MOMENTUM, NORM_EPS = 0.99, 1e-3
# Slope of the leaky unit, error at which the Huber loss turns linear.
LEAK, HUBER_DELTA = 0.1, 1.0
#: Passes over a block of rows before the partitions' parameters are averaged.
LOCAL_EPOCHS = 5
#: Rows whose layers are held at a time when errors are computed, whatever the Arrow batch size is.
ERROR_ROWS = 1024


def _init(sizes, rng, batch_norm: bool):
    p = {}
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        limit = np.sqrt(6.0 / (a + b))
        p[f"W{i}"] = rng.uniform(-limit, limit, size=(a, b))
        p[f"b{i}"] = np.zeros(b)
        if batch_norm and i < len(sizes) - 2:
            p[f"g{i}"], p[f"h{i}"] = np.ones(b), np.zeros(b)
    for k in list(p):
        p["m_" + k] = np.zeros_like(p[k])
        p["v_" + k] = np.zeros_like(p[k])
    for i, b in enumerate(sizes[1:-1]):
        if batch_norm:
            p[f"mean{i}"], p[f"var{i}"] = np.zeros(b), np.ones(b)
    p["t"] = np.zeros(1)
    return p


def _act(z, kind: str):
    if kind == "elu":
        return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))
    return np.maximum(z, LEAK * z if kind == "leaky_relu" else 0)


def _act_slope(z, kind: str):
    if kind == "elu":
        return np.where(z > 0, 1.0, np.exp(np.minimum(z, 0)))
    return np.where(z > 0, 1.0, LEAK if kind == "leaky_relu" else 0.0)


def _forward(p, X, L, opts, rng=None):
    """Output and what the backward pass needs of each layer; ``rng`` is given in training only."""
    h, kept, kind, rate = X, [], opts.get("activation", "relu"), opts.get("dropout", 0.0)
    if rng is not None and opts.get("noise"):
        h = h + rng.normal(0.0, opts["noise"], h.shape)
    for i in range(L):
        raw = z = h @ p[f"W{i}"] + p[f"b{i}"]
        if i == L - 1:
            kept.append((h, raw, None, None, None))
            return z, kept
        norm = mask = None
        if f"g{i}" in p:
            mean, var = (z.mean(axis=0), z.var(axis=0)) if rng is not None else (p[f"mean{i}"], p[f"var{i}"])
            std = np.sqrt(var + NORM_EPS)
            unit = (z - mean) / std
            z = p[f"g{i}"] * unit + p[f"h{i}"]
            norm = (unit, std, mean, var)
        if rng is not None and rate and i != (L - 2) // 2:
            mask = (rng.random(z.shape) >= rate) / (1.0 - rate)
        kept.append((h, raw, z, norm, mask))
        h = _act(z, kind)
        if mask is not None:
            h = h * mask
    return h, kept


def _loss(diff, kind: str):
    """Loss of every entry and its slope."""
    if kind == "mae":
        return np.abs(diff), np.sign(diff)
    if kind == "huber":
        near = np.clip(diff, -HUBER_DELTA, HUBER_DELTA)
        return near * (diff - near / 2), near
    return diff ** 2, 2 * diff


def _gradients(p, X, L, loss_kind: str, opts, rng):
    """Summed loss of the rows, gradients of its mean, batch-norm statistics."""
    out, kept = _forward(p, X, L, opts, rng)
    each, slope = _loss(out - X, loss_kind)
    total, g = float(each.mean(axis=1).sum()), slope / slope.size
    kind, l1, narrow = opts.get("activation", "relu"), opts.get("l1", 0.0), (L - 2) // 2
    grads, stats = {}, {}
    for i in range(L - 1, -1, -1):
        h, raw, z, norm, mask = kept[i]
        if i < L - 1:
            if mask is not None:
                g = g * mask
            g = g * _act_slope(z, kind)
            if norm is not None:
                unit, std, mean, var = norm
                grads[f"g{i}"], grads[f"h{i}"] = (g * unit).sum(axis=0), g.sum(axis=0)
                u = g * p[f"g{i}"]
                g = (u - u.mean(axis=0) - unit * (u * unit).mean(axis=0)) / std
                stats[f"mean{i}"], stats[f"var{i}"] = mean, var
            if l1 and i == narrow:
                total += l1 * float(np.abs(raw).sum())
                g = g + l1 * np.sign(raw) / len(X)
        grads[f"W{i}"], grads[f"b{i}"] = h.T @ g, g.sum(axis=0)
        if i:
            g = g @ p[f"W{i}"].T
    return total, grads, stats


def _recon_err(p, X, L, opts):
    errors = np.empty(len(X))
    for at in range(0, len(X), ERROR_ROWS):
        part = X[at:at + ERROR_ROWS]
        errors[at:at + ERROR_ROWS] = ((part - _forward(p, part, L, opts)[0]) ** 2).mean(axis=1)
    return errors


def _scaled(fm: DataFrame, base: DataFrame, scaler: str) -> DataFrame:
    if scaler == "quantile":
        return quantile_normal(fm, fit_on=base)
    if scaler not in ("standard", "robust"):
        raise ValueError(f"unknown scaler {scaler!r}")
    return apply_scaling(fm, feature_stats(base, robust=scaler == "robust"))


def autoencoder_scores(fm: DataFrame, train: DataFrame | None = None, preset: str = "deep", epochs: int | None = None,
                       seed: int = 42, scaler: str = "standard", windows: tuple[int, int] | None = None,
                       loss: str | None = None, **options) -> DataFrame:
    """``(row_id, score)``. ``loss`` and the options ``dropout``, ``l1``, ``noise``, ``activation`` replace the preset's. ``windows=(length, stride)`` trains on windows of consecutive rows (in
    ``row_id`` order) and gives every row the mean score of the windows that cover it."""
    from rowscope.session import reliable_checkpoint

    if unknown := set(options) - {"dropout", "l1", "noise", "activation"}:
        raise ValueError(f"unknown options {sorted(unknown)}")
    if options.get("activation", "relu") not in ("relu", "elu", "leaky_relu"):
        raise ValueError(f"unknown activation {options['activation']!r}")
    if not 0 <= options.get("dropout", 0.0) < 1 or options.get("l1", 0.0) < 0 or options.get("noise", 0.0) < 0:
        raise ValueError("dropout must be in [0, 1), l1 and noise at least 0")
    if loss not in (None, "mse", "mae", "huber"):
        raise ValueError(f"unknown loss {loss!r}")
    cfg = dict(PRESETS[preset])
    base = train if train is not None else fm
    fm_s, tr_s = _scaled(fm, base, scaler), _scaled(base, base, scaler)
    if cfg["pca"]:
        tr_p = reliable_checkpoint(pca(tr_s, cfg["pca"]).select("row_id", "x"))
        fm_s = pca(fm_s, cfg["pca"], fit_on=tr_s)
        tr_s = tr_p
    fm_s, tr_s = fm_s.select("row_id", "x"), tr_s.select("row_id", "x")
    ids = None
    if windows:
        from rowscope.operators.sequence import make_windows, windows_to_points
        from rowscope.plans.ordering import row_index

        d = dims(tr_s)
        def cut(m):  # noqa: E306
            flat = m.select("row_id", *[F.col("x")[i].alias(f"f{i}") for i in range(d)])
            w = make_windows(flat, [f"f{i}" for i in range(d)], ["row_id"], length=windows[0], stride=windows[1])
            return w.select(F.col("win_start").alias("row_id"), F.col("window").alias("x"))
        ids = row_index(fm_s.select("row_id"), ["row_id"])
        fm_s, tr_s = cut(fm_s), cut(tr_s)
    d = dims(tr_s)
    sizes = [d, *cfg["hidden"], d]
    L = len(sizes) - 1
    lr, bs, loss_kind = cfg["lr"], cfg["batch"], loss or cfg["loss"]

    def step(p, X, rng_, st):
        p = dict(p)
        order = rng_.permutation(len(X))
        total = 0.0
        for i in range(0, len(X), bs):
            summed, grads, stats = _gradients(p, X[order[i:i + bs]], L, loss_kind, options, rng_)
            total += summed
            p["t"] = p["t"] + 1
            t = p["t"][0]
            for k, gk in grads.items():
                p["m_" + k] = B1 * p["m_" + k] + (1 - B1) * gk
                p["v_" + k] = B2 * p["v_" + k] + (1 - B2) * gk * gk
                mh, vh = p["m_" + k] / (1 - B1 ** t), p["v_" + k] / (1 - B2 ** t)
                p[k] = p[k] - lr * st["lr_scale"] * mh / (np.sqrt(vh) + ADAM_EPS)
            for k, s in stats.items():
                p[k] = NORM_MOMENTUM * p[k] + (1 - NORM_MOMENTUM) * s
        return p, total

    epochs = epochs if epochs is not None else cfg["epochs"]
    params, _ = average_fit(tr_s, _init(sizes, np.random.default_rng(seed), cfg["batch_norm"]), step,
                            rounds=-(-epochs // LOCAL_EPOCHS), local_epochs=min(LOCAL_EPOCHS, epochs),
                            val_fraction=cfg["val_fraction"], patience=cfg["patience"], plateau=cfg["plateau"],
                            loss_fn=lambda p, X: _recon_err(p, X, L, options), seed=seed)
    bc = fm.sparkSession.sparkContext.broadcast({k: v for k, v in params.items() if not k.startswith(("m_", "v_"))})

    def run(batches):
        for pdf in batches:
            if not pdf.empty:
                X = np.stack(pdf["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "score": _recon_err(bc.value, X, L, options)})

    scores = spread(fm_s).mapInPandas(run, "row_id long, score double")
    if windows:
        points = windows_to_points(scores.withColumnRenamed("row_id", "win_start"), fm.count(), windows[0])
        return ids.join(points, "row_idx").select("row_id", "score")
    return scores
