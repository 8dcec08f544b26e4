"""Language identification as inference of a multilingual mixture.

Training counts byte trigrams (hashed to ``GRAMS`` cells) of every labelled text for
each language in one distributed aggregation. A document is a bag of words, each word
has a likelihood under every language from its trigrams, and expectation-maximisation
estimates the proportions of the languages in the document. The set of languages is
chosen by penalised likelihood: languages enter in the order of their proportions as
long as the refitted log-likelihood gains more than the penalty of a parameter.

The model has languages x GRAMS cells, whatever the corpus; it is broadcast.

Defined results: null text and text without a letter give ``und`` with score 0 and an
empty mixture; ties go to the language first in name order; rows without a language
teach nothing; with no training rows every document is ``und``. Repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import bounded_batches, fold, id_text, slices, utf8

GRAMS = 1 << 16
SMOOTHING = 0.2
ROUNDS = 8
REFIT = 5
PENALTY = 1.0

_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cell of every letter byte, its row, the first letter of every word and each word's row."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(col, "")))
    m = np.full(len(data) + len(off) + 1, 32, np.uint32)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(len(data)) + row + 1  # one space before each row
    m[at] = _LETTER[data]
    key = (m[:-2] << np.uint32(16)) | (m[1:-1] << np.uint32(8)) | m[2:]
    inside = m[1:-1] != 32
    first = inside & (m[:-2] == 32)
    own = np.flatnonzero(inside)
    cell = ((key[own] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    rows = np.zeros(len(m), np.int64)
    rows[at] = row
    letter_row = rows[1:-1][own]
    starts = np.flatnonzero(first[own])
    return cell, letter_row, starts, letter_row[starts]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Language names and the (GRAMS, languages) table of log probabilities."""
    own = bounded_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang is not null and text is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                codes = part.column("lang").dictionary_encode()
                cell, row, _, _ = grams(part.column("text"))
                k = len(codes.dictionary)
                own = np.bincount(codes.indices.to_numpy()[row] * GRAMS + cell, minlength=k * GRAMS).reshape(k, GRAMS)
                for i, name in enumerate(codes.dictionary.to_pylist()):
                    total[name] = total.get(name, 0) + own[i]
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(counts[at], pa.int64())], names=["lang", "cell", "n"])

    found = own.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(
        F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(found["lang"].unique().tolist())
    table = np.zeros((GRAMS, len(names)))
    for i, name in enumerate(names):
        mine = found[found["lang"] == name]
        table[mine["cell"].to_numpy(), i] = mine["n"].to_numpy()
    table += SMOOTHING
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int):
    """Proportions after some rounds and the log-likelihood of every document under them.
    ``like``: (words, languages) relative likelihoods; ``first``: each document's first word."""
    n = np.diff(np.append(first, len(doc)))[:, None]
    for _ in range(rounds):
        post = share[doc] * like
        post /= post.sum(axis=1, keepdims=True)
        share = np.add.reduceat(post, first, axis=0) / n
    return share, np.add.reduceat(np.log((share[doc] * like).sum(axis=1)), first)


def mixtures(like: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(documents, languages) proportions of the language set of best penalised likelihood.
    ``doc`` numbers the documents 0.. in word order, each with at least one word."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    docs, langs = len(first), like.shape[1]
    words = np.diff(np.append(first, len(doc)))
    share, _ = _em(like, doc, first, np.full((docs, langs), 1 / langs, like.dtype), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best = (place == 0).astype(like.dtype)
    value = np.add.reduceat(np.log(np.maximum((best[doc] * like).sum(axis=1), 1e-30)), first)
    live = np.arange(docs)
    for k in range(2, langs + 1):
        if not len(live):
            break
        mask = np.zeros(docs, bool)
        mask[live] = True
        take = mask[doc]
        sub, own = like[take], np.searchsorted(live, doc[take])
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        start = np.where(place[live] < k, np.maximum(share[live], 1e-3), 0).astype(like.dtype)
        fitted, ll = _em(sub, own, begin, start / start.sum(axis=1, keepdims=True), REFIT)
        better = ll > value[live] + PENALTY * np.log(words[live] + 1.0)
        best[live[better]], value[live[better]] = fitted[better], ll[better]
        live = live[better]
    return best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and the mixture (language -> share) of every document."""
    source = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                     ("mixture", pa.map_(pa.string(), pa.float64()))])

    def run(batches):
        names, table = held.value
        for batch in batches:
            for part in slices(batch):
                pred, score, mix = ["und"] * part.num_rows, [0.0] * part.num_rows, [[] for _ in range(part.num_rows)]
                cell, _, starts, wrow = grams(part.column("text"))
                if len(names) and len(starts):
                    like = np.add.reduceat(table[cell], starts, axis=0)
                    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -30))
                    rows, doc = np.unique(wrow, return_inverse=True)
                    share = mixtures(like, doc)
                    top = share.argmax(axis=1)
                    odd = _letterless(part.column("text"), rows)
                    for i, (r, t) in enumerate(zip(rows.tolist(), top.tolist(), strict=True)):
                        if r not in odd:
                            pred[r], score[r] = names[t], min(1.0, float(share[i, t]))
                            mix[r] = [(names[j], float(share[i, j])) for j in np.flatnonzero(share[i] > 0)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                     pa.array(mix, out.field("mixture").type)], schema=out)

    return source.mapInArrow(run, "doc_id bigint, lang_pred string, score double, mixture map<string,double>")


def _letterless(col: pa.Array, rows: np.ndarray) -> set[int]:
    """Rows that have non-ASCII characters but no letter (the rest have a-z)."""
    plain = pc.fill_null(pc.match_substring_regex(col, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    return {r for r in rows.tolist() if not plain[r] and not any(c.isalpha() for c in col[r].as_py() or "")}


def languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predictions for all documents, learned from those outside the held-out fold."""
    model = train(docs.where(F.coalesce(fold("doc_id", folds) != held, F.lit(True))))
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
