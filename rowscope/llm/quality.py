"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a text (``STATS``) are computed once, in Arrow slices.
2. A random forest is grown on a bounded sample of labelled rows; every path from a
   root to a node is a conjunctive rule.
3. A lasso logistic regression weighs the rules; most weights become zero.
4. The remaining rules are compiled into one Spark column expression over the
   statistics, so scoring all documents needs no model on the executors.

The labelled sample has at most ``max_labelled`` rows, the first by a hash of the id;
everything else covers all documents.

Defined results: null text counts as empty and is scored like any text; label rows
without id or label are left out; several labels of one document count as their
majority (a tie is 1); without labels of both kinds every score is the smoothed
share of label 1. Repeated documents give repeated rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscope.llm._text import SPACE, bounded_batches, fold, fresh, id_text, shingles, slices, utf8, words

MAX_LABELLED = 20_000
TREES = 12
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3

STATS = ["n_chars", "n_words", "word_len", "upper", "digit", "stop_mark", "table_mark", "other_mark", "space",
         "wide", "line_len", "distinct", "adjacent", "repeated", "long_words"]

_CLASS = np.zeros(256, np.int64)
for _c, _bytes in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "|\t", "!#$%&*+/<=>@[\\]^_`{}~"], 1):
    _CLASS[[ord(x) for x in _bytes if x != "\t"]] = _c
_CLASS[9] = 4
_CLASS[32] = 6
_CLASS[10] = 7
_CLASS[192:] = 8  # lead bytes of non-ASCII characters
_CLASS[128:192] = 9  # continuation bytes


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of every row."""
    bits = max(1, int(rows).bit_length())
    key = np.sort((row.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=rows)[:rows]


def statistics(col: pa.Array) -> np.ndarray:
    """(rows, len(STATS)) array of finite numbers."""
    data, off = utf8(col)
    n = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    c = np.bincount(row * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10).astype(float)
    chars = np.maximum(size - c[:, 9], 1)
    start, end, hashes, woff = words(data, off, SPACE)
    nw = np.diff(woff)
    wrow = np.repeat(np.arange(n), nw)
    per_word = np.maximum(nw, 1)
    length = end - start
    sh, soff = shingles(hashes, woff)
    ns = np.diff(soff)
    same = (hashes[1:] == hashes[:-1]) & (wrow[1:] == wrow[:-1]) if len(hashes) else np.zeros(0, bool)
    return np.column_stack([
        size - c[:, 9], nw, np.bincount(wrow, length, n) / per_word, c[:, 1] / chars, c[:, 2] / chars, c[:, 3] / chars,
        c[:, 4] / chars, c[:, 5] / chars, c[:, 6] / chars, c[:, 8] / chars, chars / (c[:, 7] + 1),
        _distinct(wrow, hashes, n) / per_word, np.bincount(wrow[1:][same], minlength=n) / per_word if len(hashes) else np.zeros(n),
        1 - _distinct(np.repeat(np.arange(n), ns), sh, n) / np.maximum(ns, 1),
        np.bincount(wrow[length > 20], minlength=n) / per_word]).astype(float)


def with_stats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """All columns of the documents and the statistics as one array column; returns its name too."""
    (name,) = fresh(docs, "stats")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                s = statistics(part.column(text_col))
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1]), pa.int32()),
                                               pa.array(np.ascontiguousarray(s).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, name])

    schema = docs.select("*", F.array(F.lit(0.0)).alias(name)).schema
    return bounded_batches(docs).mapInArrow(run, schema), name


def rule_paths(debug: str) -> list[tuple]:
    """Every path of the printed trees, as a tuple of (feature, operator, threshold)."""
    found: dict[tuple, None] = {}
    path: list[tuple[int, tuple]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            found.setdefault(tuple(sorted({p[1] for p in path})))
        elif "Tree" in line:
            path = []
    return list(found)


def compiled(rule: tuple, stats: str) -> Column:
    out = F.lit(True)
    for feature, op, threshold in rule:
        value = F.col(stats)[feature]
        out = out & (value <= F.lit(threshold) if op == "<=" else value > F.lit(threshold))
    return out


class Rules:
    """Weighted rules; ``score`` is a column expression over the statistics."""

    def __init__(self, intercept: float, weighted: list[tuple[tuple, float]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self, stats: str) -> Column:
        z = F.lit(float(self.intercept))
        for rule, weight in self.weighted:
            z = z + F.when(compiled(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        label_id: str = "doc_id", max_labelled: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH,
        lasso: float = LASSO, seed: int = 7) -> Rules:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    from rowscope.session import reliable_checkpoint

    known = (labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .where("doc_id is not null and y is not null").groupBy("doc_id")
             .agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    own, stats = with_stats(id_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id"))
    # dealt evenly, then ordered: rows arrive in any order, and the forest draws by place
    train = reliable_checkpoint(own.select(F.col(stats).alias("stats"), array_to_vector(stats).alias("x"), "y", "doc_id")
                                .repartition(4).sortWithinPartitions("doc_id", "stats", "y").drop("doc_id"))
    n, ones = train.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < (ones or 0) < n:
        p = ((ones or 0) + 1) / (n + 2)
        return Rules(float(np.log(p / (1 - p))), [])
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed,
                                    subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(train)
    rules = rule_paths(forest.toDebugString)
    table = train.select("y", array_to_vector(F.array(*[compiled(r, "stats").cast("double") for r in rules])).alias("r"))
    model = LogisticRegression(featuresCol="r", labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(table)
    weights = model.coefficients.toArray()
    return Rules(float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the statistics of every document."""
    own, stats = with_stats(id_text(docs, id_col, text_col))
    return own.select("doc_id", rules.score(stats).alias("score"), F.col(stats).alias("stats"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """Scores with fold 0 held out of the training labels."""
    rules = fit(docs, labels.where(fold("doc_id", folds) != 0))
    return score(docs, rules).select(
        "doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text",
              folds: int = 5) -> DataFrame:
    """The documents that the classifier accepts, columns unchanged."""
    rules = fit(docs, labels.where(fold("doc_id", folds) != 0), text_col=text_col)
    own, stats = with_stats(docs, text_col)
    return own.where(rules.score(stats) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
