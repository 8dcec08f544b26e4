"""Forests and neighbours stay bounded wherever they are held."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect import autoencoder, iforest, inne, lof, neighbours
from rowscope.detect.lof import knn
from rowscope.operators import evaluate


def _rows(spark, n=300, d=6):
    x = np.random.default_rng(8).normal(size=(n, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[7] + 1).tolist()), (None, x[3].tolist())]
    return spark.createDataFrame(rows, "row_id long, x array<double>")


def test_large_forest_never_meets_on_the_driver(spark, monkeypatch):
    fm = _rows(spark)
    settings = dict(trees=(5, 12), samples=(64,), ndims=(1, 2))
    key = ["row_id", "ntrees", "metric", "ndim", "score"]
    whole = sorted(iforest.grid(fm, **settings).select(key).collect(), key=str)
    monkeypatch.setattr(iforest, "BLOCK_NODES", 500)
    monkeypatch.setattr(iforest, "PART_ROWS", 90)

    def refused(self):
        raise AssertionError("the forest is taken to the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toPandas", refused)
        m.setattr(DataFrame, "collect", refused)
        blocked = iforest.grid(fm, **settings)
        alone = iforest.iforest_scores(fm, 12, 64, 2, penalize_range=True)
    parts = sorted(blocked.select(key).collect(), key=str)
    assert len(parts) == len(whole) == 302 * 8  # rows that share an id, or have none, stay rows of their own
    assert [tuple(r)[:4] for r in parts] == [tuple(r)[:4] for r in whole]
    assert np.allclose([r["score"] for r in parts], [r["score"] for r in whole], atol=1e-12)
    model, psi = iforest.fit(fm, 12, 64, 2)
    walked = iforest.score(fm, model, psi, penalize_range=True)
    assert np.allclose(sorted(r[1] for r in alone.collect()), sorted(r[1] for r in walked.collect()), atol=1e-12)


def _brute(a, ida, b, idb, k, metric):
    values = neighbours.distances(a, b, metric)
    values[ida[:, None] == idb[None, :]] = np.inf
    return [sorted((v, i) for v, i in zip(row.tolist(), idb.tolist(), strict=True) if np.isfinite(v))[:k] for row in values]


def _lists(best):
    return [[(v, i) for v, i in zip(*row, strict=True) if np.isfinite(v)] for row in zip(best.value.tolist(), best.id.tolist(), strict=True)]


@pytest.mark.parametrize("metric", ["manhattan", "euclidean", "chebyshev"])
@pytest.mark.parametrize(("na", "nb", "k", "offset"), [(300, 1100, 5, 0.0), (300, 40, 75, 1e6), (600, 600, 20, 1e40), (1, 3, 5, 0.0)])
def test_neighbours_of_two_blocks_equal_all_distances(metric, na, nb, k, offset):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(na, 7)) + offset, r.normal(size=(nb, 7)) + offset
    a[na // 2:], b[nb // 2:] = np.round(a[na // 2:]), np.round(b[nb // 2:])  # ties
    if na > 10:
        a[3, 2], b[5, 1] = np.nan, np.inf
    ida, idb = np.arange(na), np.arange(nb) + na // 2
    left, right = neighbours.nearest_between(a, ida, b, idb, k, metric)
    assert _lists(left) == _brute(a, ida, b, idb, k, metric) and _lists(right) == _brute(b, idb, a, ida, k, metric)


def test_small_blocks_do_not_multiply_the_rows_moved(spark):
    fm = _rows(spark, 1500).where("row_id is not null").dropDuplicates(["row_id"])
    sent = knn(fm, 3, "manhattan", block_rows=16)
    copies = next(int(line.split("sequence(0, ")[1].split(",")[0]) + 1 if "sequence(0, " in line else None
                  for line in sent._jdf.queryExecution().analyzed().toString().splitlines() if "explode(sequence(0, " in line)
    assert copies <= 8  # 94 blocks of 16 rows before
    x = {r["row_id"]: r["x"] for r in fm.collect()}
    ids = np.array(sorted(x))
    rows = np.array([x[i] for i in ids])
    want = dict(zip(ids.tolist(), _brute(rows, ids, rows, ids, 3, "manhattan"), strict=True))
    got = {}
    for r in sorted(sent.collect(), key=lambda r: (r["row_id"], r["rank"])):
        got.setdefault(r["row_id"], []).append((r["dist"], r["nbr_id"]))
    assert got == want


def test_rows_without_structure_need_few_tables(spark):
    near = neighbours.hashed_knn(_rows(spark, 2500, 32), 5, cell_rows=16, recall=0.95)
    assert near.recall >= 0.95 and near.tables <= 24


def test_thresholds_are_not_joined_by_key(spark):
    scores = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("algo"), F.col("id").cast("double").alias("score"))
    plan = evaluate.flags(scores)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_errors_hold_few_rows_at_a_time(monkeypatch):
    r = np.random.default_rng(4)
    sizes = [8, 16, 4, 16, 8]
    p, x, seen = autoencoder._init(sizes, r, True), r.normal(size=(5000, 8)), []
    whole = ((x - autoencoder._forward(p, x, 4, {})[0]) ** 2).mean(axis=1)
    forward = autoencoder._forward
    monkeypatch.setattr(autoencoder, "_forward", lambda p, X, *rest: (seen.append(len(X)), forward(p, X, *rest))[1])
    assert np.allclose(autoencoder._recon_err(p, x, 4, {}), whole, atol=1e-12) and max(seen) <= 1024


def test_rows_without_features_are_refused():
    col = pa.chunked_array([pa.array([[1.0, 2.0], None], pa.list_(pa.float64()))])
    with pytest.raises(ValueError):
        neighbours.matrix(col, 2)
    with pytest.raises(ValueError):
        neighbours.matrix(pa.chunked_array([pa.array([[1.0], [2.0, 3.0, 4.0]])]), 2)


def test_covers_hold_few_rows_at_a_time(monkeypatch):
    r = np.random.default_rng(6)
    x, seen = r.normal(size=(3000, 4)), []
    forest = [(r.normal(size=(32, 4)), r.uniform(0.1, 2.0, 32), r.uniform(0, 1, 32)) for _ in range(3)]
    want = np.zeros(3000)
    for c, rad, ratio in forest:
        near = np.where(((x[:, None] - c[None]) ** 2).sum(-1) <= rad[None], rad[None], np.inf)
        want += np.where(np.isfinite(near.min(axis=1)), ratio[near.argmin(axis=1)], 1.0)
    covered = inne._covered
    monkeypatch.setattr(inne, "_covered", lambda X, *rest: (seen.append(len(X)), covered(X, *rest))[1])
    assert np.allclose(inne._sums(x, forest), want, atol=1e-12) and max(seen) <= 1024


def test_exact_neighbours_move_no_candidates(spark, monkeypatch):
    """Rows stream past the block a task holds: one exchange of rows, none of candidate lists, whatever arrives together."""
    fm = _rows(spark, 900)
    monkeypatch.setattr(lof, "GROUP_ROWS", 64)
    monkeypatch.setattr(lof, "TOGETHER", 50)
    near = knn(fm, 4, "manhattan", block_rows=64)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # the lists of every pair of blocks were shuffled and ranked
    rows = [r for r in fm.collect() if r["row_id"] is not None]
    ids, x = np.array([r["row_id"] for r in rows]), np.array([r["x"] for r in rows])
    want: dict = {}
    for i, own in zip(ids.tolist(), _brute(x, ids, x, ids, 4, "manhattan"), strict=True):
        want[i] = sorted(want.get(i, []) + own)[:4]  # rows that share an id have one list
    got: dict = {}
    for r in sorted(near.collect(), key=lambda r: (r["row_id"], r["rank"])):
        got.setdefault(r["row_id"], []).append((r["dist"], r["nbr_id"]))
        assert r["rank"] == len(got[r["row_id"]])
    assert got == want


@pytest.mark.parametrize("kind", ["even", "heavy tails", "two clumps", "constant", "tiny"])
def test_short_sums_name_every_neighbour(kind):
    r = np.random.default_rng(9)
    x = {"even": lambda: r.normal(size=(5000, 12)), "heavy tails": lambda: r.standard_t(1, size=(5000, 12)), "constant": lambda: np.ones((5000, 12)),
         "two clumps": lambda: r.normal(size=(5000, 12)) + 1e4 * r.integers(0, 2, (5000, 1)), "tiny": lambda: r.normal(size=(5000, 12)) * 1e-30}[kind]()
    ids = r.permutation(5000)
    near = neighbours.Nearest(x[:90], ids[:90], 7, "manhattan")
    for at in (0, 40, 4500):
        near.meet(x[at: {0: 40, 40: 4500}.get(at)], ids[at: {0: 40, 40: 4500}.get(at)])
    assert _lists(near.best) == _brute(x[:90], ids[:90], x, ids, 7, "manhattan")


@pytest.mark.parametrize("kind", ["even", "heavy tails", "copies"])
def test_byte_sums_name_every_neighbour(kind, monkeypatch):
    r = np.random.default_rng(12)
    x = {"even": lambda: r.normal(size=(24_000, 24)), "heavy tails": lambda: r.standard_t(2, size=(24_000, 24)),
         "copies": lambda: np.repeat(r.normal(size=(4800, 24)), 5, axis=0)}[kind]()
    ids = r.permutation(24_000)
    tiny, small = [], []
    byte, whole = neighbours._byte_sums, neighbours._absolute_sums
    monkeypatch.setattr(neighbours, "_byte_sums", lambda a, b: (tiny.append(1), byte(a, b))[1])
    monkeypatch.setattr(neighbours, "_absolute_sums", lambda a, b: (small.append(a.dtype), whole(a, b))[1])
    near = neighbours.Nearest(x[:16], ids[:16], 4, "manhattan")
    near.meet(x, ids)
    assert _lists(near.best) == _brute(x[:16], ids[:16], x, ids, 4, "manhattan")
    if kind != "heavy tails":  # the 16-bit sums of whole blocks end when every row has its lists
        assert len(tiny) >= 3 and small.count(np.dtype(np.int16)) < len(tiny)


def test_byte_sums_hold_the_largest_differences():
    a = np.full((9, 2), neighbours.FEW, np.int8)
    assert (neighbours._byte_sums(a, -a) == 18 * neighbours.FEW).all() and 2 * neighbours.FEW * neighbours.BYTE < 256
