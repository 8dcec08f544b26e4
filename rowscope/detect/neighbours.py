"""Nearest neighbours without comparing all pairs (J4 and D2 with ``method="hashed"``).

Several tables of random projections: each is a tree of median cuts along random
directions, fitted on a bounded sample (``SAMPLE`` rows of least hash) until a leaf holds
``LEAF`` sampled rows, and continued by as many sign bits against the leaf's medians as
give cells of about ``cell_rows`` rows at any n. Every row is indexed in every table; the
rows of a cell are compared exactly and keep their k best, and the tables' candidates
merge per row. A cell that stays larger (very many equal or nearly equal rows) is dealt
into parts by row hash, so that no task holds more than a few ``cell_rows`` rows.

The work is n x tables x cell_rows distances, the rows moved are n x tables. What that
takes depends on the data, so recall is measured: the k nearest of ``QUERIES`` rows are
found among all rows (one pass; every task keeps k a query), and tables are added until
the share found reaches ``recall``. Structured data need few. On data without structure a
small cell holds a row and its neighbour by little more than chance, so every further
round of tables has cells four times as large, up to ``CELL_LIMIT`` rows: the number of
tables, and what is moved and stored, grows with the logarithm of n; the distances come
near those of the exact method. Method, number of tables and measured recall are returned
with the neighbours.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscope.session import reliable_checkpoint

SAMPLE = 16_384
LEAF = 24
QUERIES = 200
#: Numbers that one block of differences may hold.
_CELLS = 4_000_000
#: Largest cells that the rounds of ``hashed_knn`` come to.
CELL_LIMIT = 16_384
#: Rows of the two sides of one block of distances.
BLOCK = (64, 4096)
#: Largest value of the 8-bit sums, and how many differences of such values a byte can hold.
FEW, BYTE = 31, 4


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of a and of b, one bounded block of differences at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        if metric == "manhattan":
            out[i:i + step] = np.abs(diff).sum(-1)
        elif metric == "euclidean":
            out[i:i + step] = np.sqrt((diff * diff).sum(-1))
        elif metric == "chebyshev":
            out[i:i + step] = np.abs(diff).max(-1)
        else:
            raise ValueError(metric)
    return out


class KBest:
    """The k best (value, id) of every query over blocks that are offered one after the other."""

    def __init__(self, n_queries: int, k: int):
        self.value = np.full((n_queries, k), np.inf)
        self.id = np.full((n_queries, k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        """A value above this cannot enter a query's list any more."""
        return self.value[:, -1]

    def offer(self, rows: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        """Values (queries ``rows`` x block) of the block's ids; infinite values are none."""
        k = self.value.shape[1]
        if values.shape[1] > 4 * k:  # ties with the k-th value stay, whatever their number
            kth = np.partition(values, k - 1, axis=1)[:, k - 1]
            near = values <= np.minimum(kth, self.bound()[rows])[:, None]
        else:
            near = values <= self.bound()[rows][:, None]
        near &= np.isfinite(values)
        width = int(near.sum(axis=1).max(initial=0))
        if not width:
            return
        order = np.argsort(~near, axis=1, kind="stable")[:, :width]
        took = np.take_along_axis(near, order, axis=1)
        v = np.where(took, np.take_along_axis(values, order, axis=1), np.inf)
        i = np.where(took, ids[order], np.iinfo(np.int64).max)
        v, i = np.concatenate([self.value[rows], v], axis=1), np.concatenate([self.id[rows], i], axis=1)
        best = np.lexsort((i, v), axis=1)[:, :k]
        self.value[rows] = np.take_along_axis(v, best, axis=1)
        self.id[rows] = np.take_along_axis(i, best, axis=1)

    def offer_pairs(self, rows: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        """Single (query, value, id) entries in any order."""
        if not len(rows):
            return
        k = self.value.shape[1]
        order = np.lexsort((ids, values, rows))
        own, start, count = np.unique(rows[order], return_index=True, return_counts=True)
        rank = np.arange(len(rows)) - np.repeat(start, count)
        keep = rank < k
        at = (np.repeat(np.arange(len(own)), count)[keep], rank[keep])
        v = np.full((len(own), min(k, int(count.max()))), np.inf)
        i = np.full(v.shape, np.iinfo(np.int64).max)
        v[at], i[at] = values[order][keep], ids[order][keep]
        v, i = np.concatenate([self.value[own], v], axis=1), np.concatenate([self.id[own], i], axis=1)
        best = np.lexsort((i, v), axis=1)[:, :k]
        self.value[own] = np.take_along_axis(v, best, axis=1)
        self.id[own] = np.take_along_axis(i, best, axis=1)

    def rows(self, query_ids: np.ndarray, names: tuple[str, str, str]) -> pd.DataFrame:
        q, c = np.nonzero(np.isfinite(self.value))
        return pd.DataFrame({names[0]: query_ids[q].astype(np.int64), names[1]: self.id[q, c], names[2]: self.value[q, c]})


class Nearest:
    """The k nearest of a block of rows, among other rows that are offered one part after the other.

    Manhattan distances are first summed in 16-bit whole numbers: values are centred, scaled so that a sum cannot
    overflow, clipped and rounded. Clipping only shortens a distance, and a row's rounding is known, so these sums
    name every pair that can be among the k best; where they name many, float32 sums within a rounding bound name
    fewer. Once every row has k others, sums of 8-bit values, bounded in the same way but clipped and rounded more,
    come first, and the 16-bit sums are taken of the pairs that these name; where they name too many, of the whole block,
    and the next blocks but one in eight go without them. Only named pairs are computed in full: the result equals that
    of ``distances``. A row with a value that is not finite is at no finite distance from any row; rows of one id are
    not compared. Rows that come with a ``limit`` (k others are known within it) have no others beyond it in their lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, metric: str, limit: np.ndarray | None = None):
        self.x, self.ids, self.k, self.metric = x, ids, k, metric
        self.best = KBest(len(x), k)
        self.limit = np.full(len(x), np.inf) if limit is None else limit.copy()  # no value above it can be among the k best
        self.given = self.limit.copy()
        own = np.flatnonzero(np.isfinite(x).all(axis=1))
        if limit is not None:  # the rows with a limit first
            own = own[np.argsort(np.isinf(limit[own]), kind="stable")]
        d = x.shape[1]
        self.top, self.scale = (32766 // (2 * d) if d else 0), 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = x[own[:4096]].mean(axis=0) if len(own) else np.zeros(d)
            far = np.abs(x[own] - self.centre).max(axis=1, initial=0)
        if metric == "manhattan" and self.top >= 4 and len(own) and np.isfinite(far).all() and far.max() < 1e30:
            # a hundredth of the rows may reach further: they are summed in float32
            self.scale = float(np.quantile(far, 0.99) or far.max() or 1.0) / self.top
        if self.scale < 1e-30:
            self.scale = 0.0
        wide = far > self.scale * self.top
        self.parts = [own[~wide], own[wide]] if self.scale else [own[:0], own]
        self.small, self.lost = self._small(x[self.parts[0]]) if self.scale else (np.zeros((d, 0), np.int16), np.zeros(0))
        self.step, self.wasted, self.turn = 0.0, False, 0
        if self.scale and 2 * BYTE <= d <= 32766 // (2 * FEW):
            self.step = float(np.quantile(np.abs(x[self.parts[0][:4096]] - self.centre), 0.98)) / FEW
        if self.step < 1e-30:
            self.step = 0.0
        self.tiny, self.gone = self._tiny(x[self.parts[0]]) if self.step else (None, None)

    def _small(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 16-bit values, one row for each dimension, and the sum of each row's roundings."""
        return self._whole(x, self.scale, self.top, np.int16)

    def _tiny(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in 8 bits."""
        return self._whole(x, self.step, FEW, np.int8)

    def _whole(self, x: np.ndarray, scale: float, top: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        out, lost = np.empty((x.shape[1], len(x)), kind), np.empty(len(x))
        for at in range(0, len(x), 4096):
            exact = np.clip((x[at:at + 4096] - self.centre) / scale, -top, top)
            whole = np.rint(exact)
            out[:, at:at + 4096] = whole.T
            lost[at:at + 4096] = np.abs(exact - whole).sum(axis=1)
        return out, lost

    def meet_own(self) -> None:
        """The block's rows meet each other. The sums of a pair whose two rows have a limit are taken once for both."""
        near = self.parts[0]
        known = int(np.isfinite(self.limit[near]).sum())
        if not self.step or known < 2:
            self.meet(self.x, self.ids)
            return
        rest = np.concatenate([near[known:], self.parts[1]])
        if len(rest):
            self._meet(self.x, self.ids, known, len(near), True)
            self._meet(self.x[rest], self.ids[rest], 0, known, False)
        step, wide = BLOCK
        self.lines = np.ascontiguousarray(self.small[:, :known].T)  # single pairs are read from rows
        for j in range(0, known, wide):
            last = min(j + wide, known)
            for i in range(0, last, step):
                self._meet_both(i, min(i + step, last), max(i, j), last)

    def _meet_both(self, i: int, end: int, j: int, last: int) -> None:
        """The rows of near[i:end] and near[j:last], j = i or j >= end."""
        a, b = self.parts[0][i:end], self.parts[0][j:last]
        at = None
        self.turn += 1
        if not self.wasted or self.turn % 8 == 0:
            near = _byte_sums(self.tiny[:, i:end], self.tiny[:, j:last])
            at = self._within(near, i, end, j, last, self.step, self.gone)
            self.wasted = len(at) > near.size // 20
            if self.wasted:
                at = None
        if at is None:
            near = _absolute_sums(self.small[:, i:end], self.small[:, j:last])
            at = self._within(near, i, end, j, last, self.scale, self.lost)
        for part in range(0, len(at), 1 << 14):
            r, c = np.divmod(at[part:part + (1 << 14)], last - j)
            keep = (i + r < j + c) & (self.ids[a[r]] != self.ids[b[c]])
            r, c = r[keep], c[keep]
            sums = np.abs(self.lines[i + r] - self.lines[j + c]).sum(axis=1) - self.lost[i + r] - self.lost[j + c] - 0.01
            r, c = a[r], b[c]
            keep = sums <= np.maximum(self.limit[r], self.limit[c]) / self.scale
            r, c = r[keep], c[keep]
            value = _single(self.x[r], self.x[c], self.metric)
            for rows, others in ((r, c), (c, r)):
                keep = np.isfinite(value) & (value <= self.limit[rows])
                self.best.offer_pairs(rows[keep], value[keep], self.ids[others[keep]])
            for rows in (a, b):
                self.limit[rows] = np.minimum(self.limit[rows], self.best.bound()[rows])

    def _within(self, near, i: int, end: int, j: int, last: int, scale: float, lost: np.ndarray) -> np.ndarray:
        """Places of the sums that can be within the limit of their row or of their column."""
        most = []
        for own, other in ((slice(i, end), slice(j, last)), (slice(j, last), slice(i, end))):
            limit = self.limit[self.parts[0][own]] / scale + lost[own] + float(lost[other].max(initial=0)) + 0.01
            most.append(np.minimum(limit, 32767).astype(np.int16))
        named = near <= most[0][:, None]
        named |= near <= most[1][None, :]
        return np.flatnonzero(named)

    def meet(self, b: np.ndarray, idb: np.ndarray) -> None:
        self._meet(b, idb, 0, len(self.parts[0]), True)

    def _meet(self, b: np.ndarray, idb: np.ndarray, lo: int, hi: int, far: bool) -> None:
        """The rows lo to hi of the first part and, if ``far``, those of the second meet the rows of b."""
        if b.shape[1] != self.x.shape[1]:
            raise ValueError("all rows need an array of the same length")
        ok = np.isfinite(b).all(axis=1)
        b, idb = (b, idb) if ok.all() else (b[ok], idb[ok])
        step, wide = BLOCK
        for j in range(0, len(b), wide):
            y, idy = b[j:j + wide], idb[j:j + wide]
            if self.scale:
                with np.errstate(over="ignore"):
                    small, lost = self._small(y)
                    tiny, gone = self._tiny(y) if self.step else (None, np.zeros(0))
                    clipped = (np.abs(y - self.centre) > self.scale * self.top).any(axis=1)
                most, gone = float(lost.max(initial=0)), float(gone.max(initial=0))
                for i in range(lo, hi, step):
                    end = min(i + step, hi)
                    if not self._meet_tiny(i, end, y, idy, small, most, tiny, gone):
                        self._meet_small(i, end, y, idy, small, most, clipped)
            for i in range(0, len(self.parts[1]) if far else 0, step):
                rows = self.parts[1][i:i + step]
                self._take(rows, *self._fine(rows, y, idy), y, idy)

    def _meet_tiny(self, i: int, end: int, y, idy, small, lost: float, tiny, gone: float) -> bool:
        """Whether the 8-bit sums named few enough pairs of the block, which are dealt with then."""
        rows = self.parts[0][i:end]
        limit = self.limit[rows]
        if not self.step or not np.isfinite(limit).all():
            return False
        self.turn += 1
        if self.wasted and self.turn % 8:
            return False
        near = _byte_sums(self.tiny[:, i:end], tiny)
        most = np.minimum(limit / self.step + self.gone[i:end] + gone + 0.01, 32767).astype(np.int16)
        at = np.flatnonzero(near <= most[:, None])
        self.wasted = len(at) > near.size // 100
        if self.wasted:
            return False
        r, c = np.divmod(at, max(1, len(y)))
        sums = np.abs(self.small[:, i:end][:, r] - small[:, c]).sum(axis=0)
        keep = sums <= limit[r] / self.scale + self.lost[i:end][r] + lost + 0.01
        self._take(rows, r[keep], c[keep], y, idy)
        return True

    def _meet_small(self, i: int, end: int, y, idy, small, lost: float, clipped) -> None:
        rows = self.parts[0][i:end]
        near = _absolute_sums(self.small[:, i:end], small)
        limit, slack = self.limit[rows], self.lost[i:end] + lost + 0.01
        if np.isinf(limit).any() and len(y) > self.k:
            known = np.where(clipped[None, :] | (self.ids[rows][:, None] == idy[None, :]), np.int16(32767), near)
            kth = np.partition(known, self.k - 1, axis=1)[:, self.k - 1]
            limit = self.limit[rows] = np.minimum(limit, np.where(kth < 32767, (kth + slack) * self.scale, np.inf))
        most = np.minimum(limit / self.scale + slack, 32767).astype(np.int16)
        at = np.flatnonzero(near <= most[:, None])
        if len(at) > max(near.size // 50, 4 * self.k * len(rows)):
            r, c = self._fine(rows, y, idy)
        else:
            r, c = np.divmod(at, max(1, len(y)))
        self._take(rows, r, c, y, idy)

    def _fine(self, rows, y, idy) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can be among the k best by sums in float32, or in full where those do not do."""
        x = self.x[rows]
        slack = 0.0
        near = None
        if self.metric == "manhattan" and np.isfinite(self.centre).all():
            with np.errstate(over="ignore"):
                x0, y0 = x - self.centre, y - self.centre
                size = max(np.abs(x0).sum(axis=1).max(initial=0), np.abs(y0).sum(axis=1).max(initial=0))
            if size < 1e30:
                near = _absolute_sums(np.ascontiguousarray(x0.T, np.float32), np.ascontiguousarray(y0.T, np.float32))
                slack = (x.shape[1] + 4) * 2.0 ** -23 * 2 * size + 1e-36
        if near is None:
            near = distances(x, y, self.metric)
            near[~np.isfinite(near)] = np.inf
        near[self.ids[rows][:, None] == idy[None, :]] = np.inf
        if near.shape[1] > self.k:
            kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1].astype(float)
            self.limit[rows] = np.minimum(self.limit[rows], kth + slack)
        most = np.minimum(self.limit[rows] + slack, np.finfo(near.dtype).max).astype(near.dtype)  # infinite: no pair
        return np.nonzero(near <= most[:, None])

    def _take(self, rows, r, c, y, idy) -> None:
        other = self.ids[rows[r]] != idy[c]
        r, c = r[other], c[other]
        if not len(r):
            return
        value = _single(self.x[rows[r]], y[c], self.metric)
        keep = np.isfinite(value) & (value <= self.best.bound()[rows[r]]) & (value <= self.given[rows[r]])
        self.best.offer_pairs(rows[r[keep]], value[keep], idy[c[keep]])
        self.limit[rows] = np.minimum(self.limit[rows], self.best.bound()[rows])

    def rows(self) -> tuple[KBest, np.ndarray]:
        """The lists and their ids; rows that share an id have one list."""
        ids, at = np.unique(self.ids, return_inverse=True)
        if len(ids) == len(self.ids):
            return self.best, self.ids
        merged = KBest(len(ids), self.k)
        q, c = np.nonzero(np.isfinite(self.best.value))
        merged.offer_pairs(at[q], self.best.value[q, c], self.best.id[q, c])
        return merged, ids


def _absolute_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of the columns of a and of b, in their own type."""
    near = np.zeros((a.shape[1], b.shape[1]), a.dtype)
    part = np.empty_like(near)
    for c in range(len(a)):
        np.subtract(a[c, :, None], b[c, None, :], out=part)
        np.abs(part, out=part)
        near += part
    return near


def _byte_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in 16 bits for 8-bit values of at most ``FEW``: ``BYTE`` differences are summed in a byte."""
    out = np.zeros((a.shape[1], b.shape[1]), np.int16)
    near = np.empty(out.shape, np.int8)
    part = np.empty_like(near)
    for first in range(0, len(a), BYTE):
        np.subtract(a[first, :, None], b[first, None, :], out=near)
        np.abs(near, out=near)
        for c in range(first + 1, min(first + BYTE, len(a))):
            np.subtract(a[c, :, None], b[c, None, :], out=part)
            np.abs(part, out=part)
            near += part  # wraps above 127: read without sign
        out += near.view(np.uint8)
    return out


def nearest_between(a: np.ndarray, ida: np.ndarray, b: np.ndarray, idb: np.ndarray, k: int, metric: str,
                    both: bool = True) -> tuple[KBest, KBest | None]:
    """The k nearest rows of b of every row of a and, if ``both``, the other way round; rows of one id are not compared."""
    left = Nearest(a, ida, k, metric)
    left.meet(b, idb)
    return left.best, nearest_between(b, idb, a, ida, k, metric, both=False)[0] if both else None


def _single(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of a to the same row of b."""
    diff = a - b
    if metric == "manhattan":
        return np.abs(diff).sum(axis=1)
    return np.sqrt((diff * diff).sum(axis=1)) if metric == "euclidean" else np.abs(diff).max(axis=1)


def matrix(col: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of equally long arrays as a matrix, without a Python object for each row."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count or len(pc.unique(pc.list_value_length(col))) > 1:  # flattened they would shift into each other
        raise ValueError("all rows need an array of the same length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(rows, -1)


def found_table(best: KBest, ids: np.ndarray) -> pa.Table:
    """``(row_id, nbr_id, dist, rank)`` of the queries, in batches of bounded size."""
    names = ["row_id", "nbr_id", "dist", "rank"]
    batches = [pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int32())], names=names)]
    for at in range(0, len(ids), 512):
        q, c = np.nonzero(np.isfinite(best.value[at:at + 512]))
        batches.append(pa.RecordBatch.from_arrays(
            [pa.array(ids[at + q]), pa.array(best.id[at + q, c]), pa.array(best.value[at + q, c]), pa.array((c + 1).astype(np.int32))],
            names=names))
    return pa.Table.from_batches(batches)


def nearest_to(fm: DataFrame, queries: pd.DataFrame, k: int, metric: str = "manhattan") -> DataFrame:
    """``(row_id, nbr_id, dist, rank)``: the k nearest rows of ``fm`` to each of a bounded set of queries (row_id, x), itself excluded."""
    points, ids = np.stack(queries["x"].to_numpy()).astype(float), queries["row_id"].to_numpy()
    known = fm.sparkSession.sparkContext.broadcast((points, ids))

    def run(batches):
        q, qid = known.value
        best = KBest(len(qid), k)
        every = np.arange(len(qid))
        for pdf in batches:
            if pdf.empty:
                continue
            x, c = np.stack(pdf["x"].to_numpy()).astype(float), pdf["row_id"].to_numpy()
            for at in range(0, len(c), 1024):
                d = distances(q, x[at:at + 1024], metric)
                d[qid[:, None] == c[None, at:at + 1024]] = np.inf
                best.offer(every, d, c[at:at + 1024])
        yield best.rows(qid, ("row_id", "nbr_id", "dist"))

    found = fm.select("row_id", "x").mapInPandas(run, "row_id long, nbr_id long, dist double")
    return _ranked(found, k)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row_id").orderBy("dist", "nbr_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Table:
    """One tree of median cuts with further sign bits in its leaves."""

    def __init__(self, sample: np.ndarray, n: int, cell_rows: int, rng: np.random.Generator):
        dim = sample.shape[1]
        direction, cut, child = [], [], []
        leaves: list[np.ndarray] = []
        cells = max(1.0, n / cell_rows)
        whole = max(LEAF, math.ceil(len(sample) / cells))  # sampled rows of a leaf that is a cell by itself
        todo = [(np.arange(len(sample)), None)]
        while todo:
            members, slot = todo.pop()
            me = None
            if len(members) > whole:
                d = rng.standard_normal(dim)
                z = sample[members] @ d
                t = float(np.median(z))
                left = z <= t
                if 0 < left.sum() < len(members):
                    me = len(cut)
                    direction.append(d)
                    cut.append(t)
                    child.append([0, 0])
                    todo += [(members[left], (me, 0)), (members[~left], (me, 1))]
            if me is None:
                me = -1 - len(leaves)
                leaves.append(members)
            if slot is not None:
                child[slot[0]][slot[1]] = me
        self.root = 0 if cut else -1
        self.direction = np.array(direction).reshape(-1, dim)
        self.cut, self.child = np.array(cut), np.array(child, np.int64).reshape(-1, 2)
        self.bits = max(0, math.ceil(math.log2(cells / len(leaves)))) if cells > len(leaves) else 0
        self.more = rng.standard_normal((self.bits, dim))
        self.median = np.array([np.median(sample[m] @ self.more.T, axis=0) for m in leaves]).reshape(len(leaves), self.bits)

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            z = (x[inner] * self.direction[node]).sum(axis=1)
            at[inner] = self.child[node, (z > self.cut[node]).astype(np.int64)]
        leaf = -1 - at
        signs = (x @ self.more.T > self.median[leaf]).astype(np.int64)
        return (leaf << self.bits) | (signs << np.arange(self.bits)).sum(axis=1)


@dataclass
class Neighbours:
    table: DataFrame  # row_id, nbr_id, dist, rank
    method: str
    tables: int
    recall: float


def _candidates(fm: DataFrame, tables: list[Table], first: int, k: int, metric: str, cell_rows: int,
                found: DataFrame | None = None) -> DataFrame:
    """The k best of every row among those of its cell, in each table; none beyond the k-th of its list in ``found``."""
    known = fm.sparkSession.sparkContext.broadcast(tables)

    def sizes(batches):
        count: Counter = Counter()
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), batch.num_rows)
                for t, table in enumerate(known.value, first):
                    cell, c = np.unique(table.cells(x), return_counts=True)
                    count.update(dict(zip(((t, i) for i in cell.tolist()), c.tolist(), strict=True)))
        for at in range(0, len(count), 10_000):
            part = list(islice(count.items(), at, at + 10_000))
            yield pa.RecordBatch.from_arrays([pa.array([t for (t, _), _ in part], pa.int32()), pa.array([i for (_, i), _ in part], pa.int64()),
                                              pa.array([c for _, c in part], pa.int64())], names=["t", "cell", "c"])

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), batch.num_rows)
                for t, table in enumerate(known.value, first):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(table.cells(x)), *[batch.column(c) for c in ("row_id", "x", "bound")]],
                        names=["t", "cell", "row_id", "x", "bound"])

    # the cells are counted in a pass of its own: a stored copy of the rows for each table would be larger than the input
    counts = fm.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(sizes, "t int, cell long, c long").groupBy("t", "cell").agg(
        F.sum("c").alias("c"))
    large = reliable_checkpoint(counts.where(F.col("c") > 4 * cell_rows).select(
        "t", "cell", F.ceil(F.col("c") / (2 * cell_rows)).alias("parts")))
    if found is None:
        bounded = fm.withColumn("bound", F.lit(None).cast("double"))
    else:
        bounded = fm.join(found.where(F.col("rank") == k).select("row_id", F.col("dist").alias("bound")), "row_id", "left")
    rows = bounded.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x"), "bound").mapInArrow(
        index, "t int, cell long, row_id long, x array<double>, bound double")
    # a cell of more than 4 * cell_rows rows: at most tables * n / (4 * cell_rows) of them
    dealt = rows.join(F.broadcast(large), ["t", "cell"], "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_id", "t"), F.col("parts"))))

    def local(cell: pa.Table) -> pa.Table:
        x, ids = matrix(cell.column("x"), cell.num_rows), cell.column("row_id").to_numpy()
        near = Nearest(x, ids, k, metric, pc.fill_null(cell.column("bound"), float("inf")).to_numpy())
        near.meet_own()
        return found_table(near.best, ids).drop_columns("rank")

    return dealt.select("t", "cell", "part", "row_id", "x", "bound").groupBy("t", "cell", "part").applyInArrow(
        local, "row_id long, nbr_id long, dist double")


def hashed_knn(fm: DataFrame, k: int, metric: str = "manhattan", recall: float = 0.9, tables: int = 4, cell_rows: int = 1024,
               n: int | None = None, seed: int = 11) -> Neighbours:
    """The k nearest rows of every row, found in as many tables as the measured recall asks."""
    fm = reliable_checkpoint(fm.select("row_id", "x").where("row_id is not null"))  # read twice in every round
    n = n if n is not None else fm.count()
    by_hash = fm.select("row_id", "x").orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")
    sample = by_hash.limit(SAMPLE).toPandas()
    k = max(1, min(int(k), n - 1))
    points = np.stack(sample["x"].to_numpy()).astype(float)
    queries = sample.head(min(QUERIES, len(sample)))
    truth = reliable_checkpoint(nearest_to(fm, queries, k, metric).select("row_id", "nbr_id"))
    wanted = truth.count()
    rng = np.random.default_rng(seed)
    found, used, share = None, 0, 0.0
    while share < recall:
        made = [Table(points, n, cell_rows, rng) for _ in range(tables)]
        new = _candidates(fm, made, used, k, metric, cell_rows, found)
        merged = new if found is None else found.select("row_id", "nbr_id", "dist").unionByName(new)
        # one shuffle serves both the pairs and the ranks
        once = merged.repartition("row_id").groupBy("row_id", "nbr_id").agg(F.min("dist").alias("dist"))
        found = reliable_checkpoint(_ranked(once, k))
        used += tables
        share = found.join(truth, ["row_id", "nbr_id"], "left_semi").count() / wanted if wanted else 1.0
        if all(len(m.cut) == 0 and not m.bits for m in made):
            break  # one cell holds all rows: nothing more to find
        if cell_rows < CELL_LIMIT:
            cell_rows = min(4 * cell_rows, CELL_LIMIT)
        else:
            tables = max(tables, used // 2)
    return Neighbours(found, "hashed", used, share)
