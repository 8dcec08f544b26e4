"""Isolation forest / extended isolation forest.

Plan: seeded per-tree samples (``sampling.tree_samples`` with the tree index
salted) → one ``applyInPandas`` group per tree grows that tree with numpy (ψ
rows, a parameter) and packs it into arrays → a forest of up to ``BLOCK_NODES`` nodes is
broadcast and ``mapInPandas`` walks all trees for each Arrow batch, level by level,
vectorised over rows. A larger forest never meets in one place: its trees are dealt into
blocks of about ``BLOCK_NODES`` nodes, every block meets every part of ``PART_ROWS`` rows
in a cogroup, and the blocks' sums of a row are added up in block order.

Splits: ``ndim = 1`` picks one feature uniformly and a threshold uniformly in
the node's range; ``ndim > 1`` draws a normal direction over ``ndim`` random
features (scaled by their ranges) and an intercept uniform in the projected
range. Growth stops at one row, equal values, or depth ⌈log2 ψ⌉. With
``weigh_by_kurtosis`` a node draws its features with probability proportional to
their kurtosis (fourth over squared second central moment) among the node's rows,
so that heavy-tailed features are split more often.

Scores (larger = more anomalous):
* ``depth``:   2^(−E[h(x)] / c(ψ)), h = leaf depth + c(leaf size) (Liu et al.). With
  ``penalize_range`` h loses 1 at every split on the path whose value of the row lies further
  from the threshold than the node's whole range: the interval of twice that range, centred at
  the split, is what the node has seen. h stays at 0 or more, scores stay in (0, 1].
* ``density``: −mean over trees of ln((leaf size / ψ) / leaf volume share), the
  volume share being the product of the kept range fractions on the path.
  Library-defined in the reference ([lib]); promised by properties, not bits. Both options
  belong to ``depth`` and are switched off for ``density``, whose volumes they would bias.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect.features import spread
from rowscope.detect.neighbours import matrix
from rowscope.detect.sampling import tree_samples
from rowscope.session import reliable_checkpoint

EULER = 0.5772156649015329
#: Fixed value: rows per tree under the setting "auto" (a tree is a sample by definition).
AUTO_SAMPLE = 10_000
#: Nodes of the trees that one place (the driver, a task) holds at a time, and rows that meet them there.
BLOCK_NODES = 1_000_000
PART_ROWS = 131_072
_SCHEMA = ("tree int, node int, left int, right int, feats array<int>, coefs array<double>, "
           "thresh double, size long, depth int, logvol double, span double")


def c_factor(m: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    big = m > 2
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER) - 2.0 * (m[big] - 1.0) / m[big]
    out[m == 2] = 1.0
    return out


def kurtosis_weights(sub: np.ndarray) -> np.ndarray:
    """Probabilities proportional to the kurtosis of each column; columns must not be constant."""
    z = sub - sub.mean(axis=0)
    z /= np.abs(z).max(axis=0)
    k = (z ** 4).mean(axis=0) / (z ** 2).mean(axis=0) ** 2
    return k / k.sum()


def _grow(X: np.ndarray, rng: np.random.Generator, ndim: int, max_depth: int, by_kurtosis: bool = False) -> list[tuple]:
    nodes: list[list] = []
    lo_all, hi_all = X.min(axis=0), X.max(axis=0)
    rng_all = np.where(hi_all > lo_all, hi_all - lo_all, 1.0)
    stack = [(np.arange(len(X)), 0, 0.0, None, None)]
    while stack:
        idx, depth, logvol, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, -1, [], [], 0.0, len(idx), depth, logvol, 0.0])
        if parent is not None:
            nodes[parent][1 if side == 0 else 2] = me
        sub = X[idx]
        if len(idx) <= 1 or depth >= max_depth:
            continue
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        live = np.nonzero(hi > lo)[0]
        if len(live) == 0:
            continue
        k = min(ndim, len(live))
        feats = rng.choice(live, size=k, replace=False, p=kurtosis_weights(sub[:, live]) if by_kurtosis else None)
        if k == 1:
            coefs = np.array([1.0])
        else:
            coefs = rng.normal(size=k) / rng_all[feats]
        proj = sub[:, feats] @ coefs
        plo, phi = proj.min(), proj.max()
        if not phi > plo:
            continue
        t = rng.uniform(plo, phi)
        go_left = proj <= t
        if go_left.all() or (~go_left).all():
            continue
        frac = (t - plo) / (phi - plo)
        nodes[me][3] = feats.astype(int).tolist()
        nodes[me][4] = coefs.tolist()
        nodes[me][5] = float(t)
        nodes[me][9] = float(phi - plo)
        stack.append((idx[~go_left], depth + 1, logvol + math.log(max(1 - frac, 1e-300)), me, 1))
        stack.append((idx[go_left], depth + 1, logvol + math.log(max(frac, 1e-300)), me, 0))
    return nodes


def _growth(fm: DataFrame, n_trees: int, sample_size: int | str, ndim: int, seed: int, n: int | None, weigh_by_kurtosis: bool):
    """Samples of the trees, the effective ψ and the function that grows a sample's tree: (tree, nodes)."""
    n = n if n is not None else fm.count()
    psi = AUTO_SAMPLE if sample_size == "auto" else int(sample_size)
    samples, psi = tree_samples(fm, n_trees, psi, n=n, tag=f"if{seed}")
    max_depth = max(1, math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> tuple[int, list]:
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree"].iloc[0])
        X = np.stack(pdf["x"].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, tree])
        return tree, _grow(X, rng, ndim, max_depth, weigh_by_kurtosis)

    return samples, psi, grow


def fit(fm: DataFrame, n_trees: int = 300, sample_size: int | str = "auto", ndim: int = 1,
        seed: int = 42, n: int | None = None, weigh_by_kurtosis: bool = False) -> tuple[DataFrame, int]:
    """Node table of the forest and the effective ψ (``auto``: ``AUTO_SAMPLE`` rows)."""
    samples, psi, grow = _growth(fm, n_trees, sample_size, ndim, seed, n, weigh_by_kurtosis)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, nodes = grow(pdf)
        return pd.DataFrame({
            "tree": tree, "node": [r[0] for r in nodes], "left": [r[1] for r in nodes],
            "right": [r[2] for r in nodes], "feats": [r[3] for r in nodes], "coefs": [r[4] for r in nodes],
            "thresh": [r[5] for r in nodes], "size": [r[6] for r in nodes], "depth": [r[7] for r in nodes],
            "logvol": [r[8] for r in nodes], "span": [r[9] for r in nodes]})

    return samples.groupBy("tree").applyInPandas(table, _SCHEMA), psi


def fit_packed(fm: DataFrame, n_trees: int = 300, sample_size: int | str = "auto", ndim: int = 1, seed: int = 42,
               n: int | None = None, weigh_by_kurtosis: bool = False) -> tuple[DataFrame, int]:
    """``(tree, packed)``: the same forest with a row for each tree, its nodes as pickled arrays."""
    samples, psi, grow = _growth(fm, n_trees, sample_size, ndim, seed, n, weigh_by_kurtosis)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, nodes = grow(pdf)
        _, left, right, feats, coefs, *rest = zip(*nodes, strict=True)
        return pd.DataFrame({"tree": [tree], "packed": [pickle.dumps(_arrays(left, right, feats, coefs, *rest))]})

    return samples.groupBy("tree").applyInPandas(pack, "tree int, packed binary"), psi


def _arrays(left, right, feats, coefs, thresh, size, depth, logvol, span) -> tuple:
    """One tree as arrays in node order; features and coefficients are filled up to the widest node with 0."""
    width = max([len(f) for f in feats] + [1])
    Fm = np.zeros((len(left), width), dtype=np.int32)
    Cm = np.zeros((len(left), width))
    for i, (f, c) in enumerate(zip(feats, coefs)):
        Fm[i, :len(f)] = f
        Cm[i, :len(c)] = c
    return (np.asarray(left, np.int32), np.asarray(right, np.int32), Fm, Cm, np.asarray(thresh, float), np.asarray(size, np.int32),
            np.asarray(depth, np.int32), np.asarray(logvol, float), np.asarray(span, float))


def _pack(model: pd.DataFrame):
    names = ["left", "right", "feats", "coefs", "thresh", "size", "depth", "logvol", "span"]
    return [_arrays(*(g[c].to_numpy() for c in names)) for _, g in model.sort_values(["tree", "node"]).groupby("tree", sort=True)]


def _add_tree(acc: dict[str, np.ndarray], X: np.ndarray, tree: tuple, psi: int, penalize_range: bool = False) -> None:
    """Adds one tree's terms of every row to the sums of the metrics."""
    left, right, Fm, Cm, th, size, depth, logvol, span = tree
    node = np.zeros(len(X), dtype=int)
    a = np.arange(len(X))[left[node] >= 0]
    while len(a):
        nd = node[a]
        proj = (X[a[:, None], Fm[nd]] * Cm[nd]).sum(axis=1)
        if penalize_range and "depth" in acc:
            acc["depth"][a] -= np.abs(proj - th[nd]) > span[nd]
        node[a] = np.where(proj <= th[nd], left[nd], right[nd])
        a = a[left[node[a]] >= 0]
    for m in acc:
        acc[m] += depth[node] + c_factor(size[node]) if m == "depth" else np.log(size[node] / psi) - logvol[node]


def score(fm: DataFrame, model: DataFrame, psi: int, metric: str = "depth",
          n_trees_used: int | None = None, penalize_range: bool = False) -> DataFrame:
    """``(row_id, score)`` by a bounded node table; ``n_trees_used`` scores with the first trees only."""
    trees = _pack(model.toPandas())  # bounded by T × 2ψ nodes
    if n_trees_used:
        trees = trees[:n_trees_used]
    return _by_broadcast(fm, trees, psi, [len(trees)], [metric], penalize_range).select("row_id", "score")


def _by_broadcast(fm: DataFrame, trees: list[tuple], psi: int, counts: list[int], metrics: list[str],
                  penalize_range: bool = False) -> DataFrame:
    bc = fm.sparkSession.sparkContext.broadcast(trees)
    cpsi = float(c_factor(psi)) if psi > 1 else 1.0

    def run(batches):
        forest = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float)
            acc = {m: np.zeros(len(X)) for m in metrics}
            for i, tree in enumerate(forest, 1):
                _add_tree(acc, X, tree, psi, penalize_range)
                if i in counts:
                    for m in metrics:
                        mean = acc[m] / i
                        yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "ntrees": i, "metric": m,
                                            "score": np.power(2.0, -mean / cpsi) if m == "depth" else -mean})

    return spread(fm.select("row_id", "x")).mapInPandas(run, "row_id long, ntrees int, metric string, score double")


def _by_blocks(fm: DataFrame, packed: DataFrame, psi: int, n: int, counts: list[int], metrics: list[str],
               penalize_range: bool = False) -> DataFrame:
    """The same scores for a forest that is too large to be held in one place."""
    counts, width = sorted(counts), max(1, BLOCK_NODES // (2 * psi))
    starts = [i for a, b in zip([0, *counts[:-1]], counts, strict=True) for i in range(a, b, width)]  # no block crosses a count
    block_of = F.array(*[F.lit(sum(s <= i for s in starts) - 1) for i in range(counts[-1])])
    parts = max(1, math.ceil(n / PART_ROWS))
    # a number of their own keeps rows apart that share an id
    rows = reliable_checkpoint(fm.select("row_id", "x").withColumn("at", F.monotonically_increasing_id()))
    left = rows.select("at", "x", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"),
                       F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1))).alias("block"))
    right = packed.where(F.col("tree") < counts[-1]).select(
        "tree", "packed", F.get(block_of, F.col("tree")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        block = trees.column("block")[0].as_py() if trees.num_rows else -1
        forest = [pickle.loads(p.as_buffer()) for p in trees.sort_by("tree").column("packed")]
        X = matrix(rows.column("x"), rows.num_rows) if rows.num_rows else np.zeros((0, 1))
        acc = {m: np.zeros(len(X)) for m in metrics}
        for lo in range(0, len(X), 8192):
            own = {m: acc[m][lo:lo + 8192] for m in metrics}
            for tree in forest:
                _add_tree(own, X[lo:lo + 8192], tree, psi, penalize_range)
        return pa.table({"at": rows.column("at"), "block": pa.array(np.full(len(X), block, np.int32)),
                         **{m: pa.array(acc[m]) for m in metrics}})

    sums = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        run, "at long, block int, " + ", ".join(f"{m} double" for m in metrics))
    # added in block order, so that equal rows have equal scores
    of_row = sums.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("block", *metrics))).alias("sums"))
    cpsi = float(c_factor(psi)) if psi > 1 else 1.0

    def value(count: int, metric: str):
        used = F.filter("sums", lambda s: s["block"] < sum(s0 < count for s0 in starts))
        mean = F.aggregate(used, F.lit(0.0), lambda a, s: a + s[metric]) / F.lit(float(count))
        return F.pow(F.lit(2.0), -mean / F.lit(cpsi)) if metric == "depth" else -mean

    told = F.explode(F.array(*[F.struct(F.lit(c).alias("ntrees"), F.lit(m).alias("metric"), value(c, m).alias("score"))
                               for c in counts for m in metrics]))
    return of_row.withColumn("told", told).join(rows.select("at", "row_id"), "at").select("row_id", "told.*")


def _scores(fm: DataFrame, packed: DataFrame, n_trees: int, psi: int, n: int, counts: list[int], metrics: list[str],
            penalize_range: bool = False) -> DataFrame:
    """``(row_id, ntrees, metric, score)`` for every count of first trees and every metric, in one pass."""
    if n_trees * 2 * psi > BLOCK_NODES:
        return _by_blocks(fm, packed, psi, n, counts, metrics, penalize_range)
    trees = [pickle.loads(r["packed"]) for r in packed.orderBy("tree").collect()]  # BLOCK_NODES nodes at most
    return _by_broadcast(fm, trees, psi, counts, metrics, penalize_range)


def iforest_scores(fm: DataFrame, n_trees: int = 300, sample_size: int | str = "auto", ndim: int = 1,
                   metric: str = "depth", seed: int = 42, weigh_by_kurtosis: bool = False,
                   penalize_range: bool = False) -> DataFrame:
    if metric == "density":
        weigh_by_kurtosis = penalize_range = False
    n = fm.count()
    packed, psi = fit_packed(fm, n_trees, sample_size, ndim, seed, n=n, weigh_by_kurtosis=weigh_by_kurtosis)
    return _scores(fm, packed, n_trees, psi, n, [n_trees], [metric], penalize_range).select("row_id", "score")


def grid(fm: DataFrame, trees=(200, 400, 800), samples=(256, 512, "auto"), ndims=(1, 3), metrics=("depth", "density"),
         seed: int = 42) -> DataFrame:
    """``(row_id, ntrees, metric, score, sample_size, ndim)`` of every setting. The largest forest per
    (sample, ndim) is grown once; smaller counts score its first trees in the same pass."""
    n = fm.count()
    out = None
    for ss in samples:
        for nd in ndims:
            packed, psi = fit_packed(fm, max(trees), ss, nd, seed, n=n)
            part = _scores(fm, packed, max(trees), psi, n, list(trees), list(metrics)).withColumns(
                {"sample_size": F.lit(str(ss)), "ndim": F.lit(nd)})
            out = part if out is None else out.unionByName(part)
    return out
