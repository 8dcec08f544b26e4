"""Helpers shared by the text operators: Arrow slices, byte-level word splitting, hashes.

Every helper works on whole texts; a slice groups consecutive rows up to a byte
budget so that the temporary arrays stay small (one longer text is a slice alone).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch: texts can be long, and a batch is held whole by Spark and by the Python worker.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, unless it is lower already."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_ROWS)) <= BATCH_ROWS:
        conf.set(_ARROW_ROWS, str(BATCH_ROWS))
    return df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs; other columns, clashing names included, stay outside."""
    return bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as set it apart from the frame's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def with_uid(df: DataFrame) -> DataFrame:
    """A row number that is a function of the input split and the row's place in it, so
    repeated ids stay apart and a recomputed task gives the same numbers."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def fold_of(doc_id, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``budget`` text bytes (or a single row)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U(33))
        x = x * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for positions 0..n."""
    if len(_POW["p"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("i", _INV)):
                v = np.full(size, U(base), np.uint64)
                v[0] = 1
                _POW[key] = np.multiply.accumulate(v)
    return _POW["p"], _POW["i"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value * base**position (wrapping), length n + 1."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    more = width - have
    return op(x[: len(x) - more], x[more:]) if more else x


#: ASCII white space separates words; everything else belongs to one.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower-cased ASCII letters, digits and all non-ASCII bytes belong to words.
ALNUM_SEP = np.ones(256, bool)
ALNUM_SEP[48:58] = False
ALNUM_SEP[65:91] = False
ALNUM_SEP[97:123] = False
ALNUM_SEP[128:] = False


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, lower: bool = True):
    """Word starts, ends, hashes and the per-row word offsets of a slice."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~sep[data]
    flank = np.zeros(n + 1, bool)
    flank[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | flank[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | flank[1:])) + 1
    return start, end, span_hash(prefix_hash(data), start, end), np.searchsorted(start, off)


def shingles(hashes: np.ndarray, woff: np.ndarray, k: int = 5):
    """Hashes of k consecutive words of a row and per-row offsets; a row of fewer words,
    but not none, is one shingle of all its words."""
    n_words = np.diff(woff)
    count = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    soff = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    first = woff[:-1][row] + (np.arange(soff[-1]) - soff[:-1][row])
    limit = woff[1:][row]
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            at = first + i
            ok = at < limit
            out += np.where(ok, hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else U(0), U(i + 1)) * U(
                (0x9FB21C651E98DF25 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(out), soff
