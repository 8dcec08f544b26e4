"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its lower-cased words with their counts. For each of
``SAMPLES`` independent samples every term draws, from hashes of the term and the
sample's number, r and c from Gamma(2, 1) and b from Uniform(0, 1); with a weight w it
offers the value

    t = floor(ln w / r + b),   value = ln c - r (t - b) - r

and the least value wins. Two documents agree in a sample with probability equal to
their generalised Jaccard similarity (sum of minima over sum of maxima of the weights).
The value depends on the term and t alone, so the winning value itself identifies the
sample; 16 bits of its hash are kept. All terms of all texts take part.

The edited text of a document replaces its last floor(n/2) code points by the first as
many of the next document. Documents are put in descending id order by cut points of
the ids, sorted inside each range, and the first document of a range also travels to
the range before it; nothing is sorted in one task.

Defined results: null text is empty; two texts without words agree in every sample, and
with any other text in none (but for chance in 16 bits); rows without id come last;
rows of one id follow each other in text order; a single row is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import SLICE_BYTES, U, id_text, utf8, words

SAMPLES = 64
_SALT = [0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03]
_PER_TASK = 4


def _uniforms(terms: np.ndarray, samples: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Two (terms, samples) arrays of uniforms in (0, 1]."""
    with np.errstate(over="ignore"):
        step = (np.arange(1, samples + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) ^ U(salt)
        x = (terms[:, None] ^ step[None, :]) * U(0xFF51AFD7ED558CCD)
        x ^= x >> U(32)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(29)
        x *= U(0x9FB21C651E98DF25)
    scale = np.float32(2.0 ** -24)
    return (((x >> U(40)).astype(np.float32) + np.float32(1)) * scale,
            ((x >> U(8)).astype(np.uint32) >> np.uint32(8)).astype(np.float32) * scale + scale)


def _values(r: np.ndarray, ln_c: np.ndarray, b: np.ndarray, t: np.ndarray | np.float32) -> np.ndarray:
    return ln_c - r * (t - b) - r


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) array of 16-bit samples; 0 throughout for a text without words."""
    data, off = utf8(pa.array(texts, pa.large_string()))
    _, _, hashes, woff = words(data, off)
    n = len(texts)
    out = np.zeros((n, samples), np.uint16)
    if not len(hashes):
        return out
    terms, code = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(woff))
    pair, weight = np.unique(row * len(terms) + code, return_counts=True)
    row, code = pair // len(terms), pair % len(terms)
    ones = np.empty((len(terms), samples), np.float32)
    many = np.zeros(len(terms), bool)
    many[code[weight > 1]] = True
    slot = np.cumsum(many) - 1
    kept = [np.empty((int(many.sum()), samples), np.float32) for _ in range(3)]
    for lo in range(0, len(terms), 4096):
        own = slice(lo, min(lo + 4096, len(terms)))
        u, v = _uniforms(terms[own], samples, _SALT[0])
        r = -np.log(u * v)
        u, v = _uniforms(terms[own], samples, _SALT[1])
        ln_c = np.log(np.maximum(-np.log(u * v), np.float32(1e-30)))
        b, _ = _uniforms(terms[own], samples, _SALT[2])
        r = np.maximum(r, np.float32(1e-12))
        b = np.minimum(b, np.float32(1 - 2.0 ** -24))
        ones[own] = _values(r, ln_c, b, np.float32(0))
        more = many[own]
        for store, value in zip(kept, (r, ln_c, b), strict=True):
            store[slot[own][more]] = value[more]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    stop = np.append(begin[1:], len(row))
    least = np.full((n, samples), np.inf, np.float32)
    at = 0
    while at < len(begin):  # some thousand terms at a time; one longer text is split
        upto = max(at + 1, int(np.searchsorted(stop, begin[at] + 8192, side="right")))
        for lo in range(begin[at], stop[upto - 1], 65536):
            hi = min(lo + 65536, stop[upto - 1])
            value = ones[code[lo:hi]]
            heavy = np.flatnonzero(weight[lo:hi] > 1)
            if len(heavy):
                r, ln_c, b = (k[slot[code[lo:hi][heavy]]] for k in kept)
                t = np.floor(np.log(weight[lo:hi][heavy].astype(np.float32))[:, None] / r + b)
                value[heavy] = _values(r, ln_c, b, t)
            own = row[lo:hi]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            rows = own[first]
            least[rows] = np.minimum(least[rows], np.minimum.reduceat(value, first, axis=0))
        at = upto
    bits = least.view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        bits = (bits * U(0x9E3779B97F4A7C15)) >> U(48)
    full = np.diff(woff) > 0
    out[full] = np.maximum(bits[full], 1).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def hexes(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u2").tobytes().hex()
    width = 4 * sig.shape[1]
    return [raw[i: i + width] for i in range(0, len(raw), width)] if width else [""] * len(sig)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, bucket, edge: rows of each bucket in descending id order, followed by an
    edge row, the first row of the next bucket; sorted inside partitions, a bucket in one of them."""
    from pyspark.ml.feature import Bucketizer

    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = source.select(F.col("doc_id").cast("double").alias("at"))
    cuts = ids.dropna().approxQuantile("at", [i / (_PER_TASK * parts) for i in range(1, _PER_TASK * parts)], 1 / (8 * _PER_TASK * parts))
    cuts = sorted(set(cuts)) or [0.0]
    place = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="bucket", handleInvalid="keep")
    last = float(len(cuts) + 1)  # where rows without id go; counted down, they come last
    rank = F.when(F.col("at").isNull(), F.lit(last)).otherwise(F.lit(float(len(cuts))) - F.col("bucket")).cast("int")
    own = place.transform(source.withColumn("at", F.col("doc_id").cast("double"))).select(
        "doc_id", "text", rank.alias("bucket"))
    heads = {r["bucket"]: r["head"] for r in own.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first bucket is read after the last
    edge = None
    if order:
        moves = docs.sparkSession.createDataFrame([(b, heads[b], before[b]) for b in order], "b int, head bigint, to int")
        edge = own.join(F.broadcast(moves), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head"))).select(
            "doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("edge"))
    both = own.withColumn("edge", F.lit(0))
    both = both.unionByName(edge) if edge is not None else both
    return both.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "edge", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _emit(rows: list[tuple], samples: int) -> pa.RecordBatch | None:
    """Result of consecutive rows (id, text, bucket, edge); the last row only serves as a next."""
    own = [i for i in range(len(rows) - 1) if not rows[i][3]]
    if not own:
        return None
    texts = [r[1] for r in rows]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
    sig = signatures(texts + edited, samples)
    plain, changed = sig[own], sig[len(texts):]
    following = sig[[i + 1 for i in own]]
    return pa.RecordBatch.from_arrays([
        pa.array([rows[i][0] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited]), pa.array(hexes(plain)), pa.array(hexes(changed)),
        pa.array(likeness(plain, changed)), pa.array(likeness(plain, following))], schema=_OUT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text, bucket, edge in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((doc_id, text or "", bucket, edge))
                size += len(rows[-1][1])
                if size > SLICE_BYTES // 2 and len(rows) > 1:
                    done = _emit(rows, samples)
                    if done is not None:
                        yield done
                    rows = rows[-1:]
                    size = len(rows[0][1])
        done = _emit(rows, samples)
        if done is not None:
            yield done

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
