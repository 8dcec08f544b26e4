"""Re-aimed text and vector operators: batch jobs over a column.

* R1 ``retrieve_topk`` — exact cosine top-k of a query set against a corpus.
* R2 ``fuzzy_match`` / ``correct_tokens`` — fuzzy key join (Levenshtein
  similarity, declared instead of WRatio) with exact q-gram prefix blocking.
* R3 ``keyword_tags`` — request routing flags and detector names per text.
* R4 ``extract_params`` — CSV path and ``EIF(...)`` parameters from text.
* R5 ``parse_actions`` — the outermost ``{…}`` of a text parsed as an action.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscope.detect.features import spread
from rowscope.detect.neighbours import KBest
from rowscope.functions.scalars import col

# ---------------------------------------------------------------- R1

MAX_BROADCAST_QUERIES = 20_000


def _normalise(X: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(X, axis=1, keepdims=True)
    return X / np.where(n == 0, 1.0, n)


def retrieve_topk(corpus: DataFrame, queries: DataFrame, k: int = 8, block_rows: int = 4096) -> DataFrame:
    """``(query_id, doc_id, rank, sim)``: for every query the k corpus rows with the
    highest cosine similarity (ties → smaller doc id). Inputs are ``(row_id, x)``.

    When the query set is at most ``MAX_BROADCAST_QUERIES`` rows (counted, so the
    bound is checked) it is broadcast and every corpus batch keeps its local top-k
    per query; otherwise queries and corpus are both blocked and each (query
    block, corpus block) pair is one group. Either way only k candidates per query
    and batch leave a task, and a final ``row_number <= k`` merges them.
    """
    nq = queries.count()
    if nq == 0:
        return corpus.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, sim double")

    def local_topk(Q, qid, C, cid):
        S = _normalise(Q) @ _normalise(C).T
        kk = min(k, S.shape[1])
        out_q, out_d, out_s = [], [], []
        for r in range(S.shape[0]):
            row = S[r]
            if kk < len(row):
                kth = np.partition(-row, kk - 1)[kk - 1]
                cand = np.nonzero(-row <= kth)[0]
            else:
                cand = np.arange(len(row))
            order = np.lexsort((cid[cand], -row[cand]))[:kk]
            sel = cand[order]
            out_q.append(np.full(len(sel), qid[r]))
            out_d.append(cid[sel])
            out_s.append(row[sel])
        return pd.DataFrame({"query_id": np.concatenate(out_q).astype(np.int64),
                             "doc_id": np.concatenate(out_d).astype(np.int64), "sim": np.concatenate(out_s)})

    schema = "query_id long, doc_id long, sim double"
    if nq <= MAX_BROADCAST_QUERIES:
        qp = queries.select("row_id", "x").toPandas()  # bounded by the checked count
        bc = corpus.sparkSession.sparkContext.broadcast(
            (np.stack(qp["x"].to_numpy()).astype(float), qp["row_id"].to_numpy()))

        def run(batches):  # one running list of k a query and task: at most k x queries x tasks rows leave it
            Q, qid = bc.value
            Q, best, every = _normalise(Q), KBest(len(qid), k), np.arange(len(qid))
            for pdf in batches:
                if pdf.empty:
                    continue
                X, ids = _normalise(np.stack(pdf["x"].to_numpy()).astype(float)), pdf["row_id"].to_numpy()
                for at in range(0, len(ids), 256):
                    best.offer(every, -(Q @ X[at:at + 256].T), ids[at:at + 256])
            found = best.rows(qid, ("query_id", "doc_id", "sim"))
            found["sim"] = -found["sim"]
            yield found

        cand = spread(corpus.select("row_id", "x")).mapInPandas(run, schema)
    else:
        nc = corpus.count()
        bq, bd = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nc / block_rows))
        qs = queries.select("row_id", "x", F.lit(0).alias("side"),
                            F.pmod(F.xxhash64("row_id"), F.lit(bq)).alias("qb"),
                            F.explode(F.sequence(F.lit(0), F.lit(bd - 1))).alias("db"))
        ds = corpus.select("row_id", "x", F.lit(1).alias("side"),
                           F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"),
                           F.pmod(F.xxhash64("row_id"), F.lit(bd)).alias("db"))

        def grp(pdf):
            q = pdf[pdf["side"] == 0]
            d = pdf[pdf["side"] == 1]
            if q.empty or d.empty:
                return pd.DataFrame({"query_id": [], "doc_id": [], "sim": []})
            return local_topk(np.stack(q["x"].to_numpy()).astype(float), q["row_id"].to_numpy(),
                              np.stack(d["x"].to_numpy()).astype(float), d["row_id"].to_numpy())

        cand = qs.unionByName(ds).groupBy("qb", "db").applyInPandas(grp, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "doc_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "doc_id", "rank", "sim")


# ---------------------------------------------------------------- R2

TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*"


def _padded_bigrams(c):
    """Padded 2-grams made unique per occurrence (``gram#k``), as an array."""
    s = F.concat(F.lit("\u0002"), c, F.lit("\u0003"))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2))
    return grams


def _prefixes(df: DataFrame, key: str, freq: DataFrame, q: int = 2, threshold: float = 0.8) -> DataFrame:
    """Prefix grams of each string under the global (frequency, gram) order.

    For a string of length L every partner within similarity ``t`` is within
    edit distance τ = ⌊(1−t)/t · L⌋ of it; two strings within edit distance τ
    share a gram among their first qτ + 1 grams (prefix filtering), so joining
    on prefix grams loses no qualifying pair.
    """
    g = df.select(key, F.posexplode(_padded_bigrams(F.col(key))).alias("p", "g"))
    g = g.withColumn("occ", F.row_number().over(Window.partitionBy(key, "g").orderBy("p")))
    g = g.withColumn("tok", F.concat_ws("#", "g", F.col("occ").cast("string")))
    g = g.join(freq, "tok")  # one row per distinct gram occurrence; AQE broadcasts it when small
    ratio = (1.0 - threshold) / threshold
    tau = F.floor(F.length(F.col(key)) * F.lit(ratio) + F.lit(1e-9))
    w = Window.partitionBy(key).orderBy("f", "tok")
    return (g.withColumn("ord", F.row_number().over(w))
            .where(F.col("ord") <= q * tau + 1).select(key, "tok"))


def fuzzy_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                threshold: float = 0.8, top: int = 3) -> DataFrame:
    """R2: for every distinct left string the ``top`` right strings with
    similarity ``1 − lev/max(len)`` ≥ threshold (case-folded), ties → smaller string.

    Returns ``(token, match, sim, rank)``.
    """
    L = left.select(F.lower(F.trim(col(left_key))).alias("token")).where(F.length("token") > 0).distinct()
    R = right.select(F.lower(F.trim(col(right_key))).alias("match")).where(F.length("match") > 0).distinct()
    both = L.select(F.col("token").alias("s")).unionByName(R.select(F.col("match").alias("s")))
    fg = both.select("s", F.posexplode(_padded_bigrams(F.col("s"))).alias("p", "g"))
    fg = fg.withColumn("occ", F.row_number().over(Window.partitionBy("s", "g").orderBy("p")))
    freq = (fg.select(F.concat_ws("#", "g", F.col("occ").cast("string")).alias("tok"))
            .groupBy("tok").agg(F.count(F.lit(1)).alias("f")))
    lp = _prefixes(L, "token", freq, threshold=threshold)
    rp = _prefixes(R, "match", freq, threshold=threshold)
    pairs = lp.join(rp, "tok").select("token", "match").distinct()
    d = F.levenshtein("token", "match")
    sim = 1.0 - d / F.greatest(F.length("token"), F.length("match"))
    scored = pairs.withColumn("sim", sim).where(F.col("sim") >= threshold - 1e-12)
    w = Window.partitionBy("token").orderBy(F.desc("sim"), "match")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def rerank(matches: DataFrame, left_vectors: DataFrame, right_vectors: DataFrame) -> DataFrame:
    """R2: one match for each token, the candidate of ``fuzzy_match`` whose vector is nearest by cosine.

    ``left_vectors(token, x)`` and ``right_vectors(match, x)`` are supplied (an embedding of each name);
    a name may have one vector. Cosines are compared to 9 digits; ties, candidates without a vector and
    vectors of length 0 fall back to the lexical rank, after all candidates with a cosine.

    Returns ``(token, match, sim, cosine, rank)``, ``rank`` being the lexical one. Two equi-joins on the
    names and one grouped maximum: no pair beyond the candidates is made.
    """
    pairs = (matches.join(left_vectors.select("token", F.col("x").alias("_a")), "token", "left")
             .join(right_vectors.select("match", F.col("x").alias("_b")), "match", "left"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot("_a", "_a")) * F.sqrt(dot("_b", "_b"))
    scored = pairs.withColumn("cosine", F.when(norm > 0, F.round(dot("_a", "_b") / norm, 9)))
    best = F.max_by(F.struct("match", "sim", "cosine", "rank"), F.struct("cosine", -F.col("rank")))
    return scored.groupBy("token").agg(best.alias("_m")).select("token", "_m.*")


def correct_tokens(texts: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, vocab_col: str,
                   threshold: float = 0.8, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """R2 applied: every name-like token of the text is replaced in place by its best
    vocabulary entry, spelled as in the vocabulary (of several spellings the smallest);
    tokens without a match and everything between tokens stay as they are. With ``vectors``
    (of tokens and of entries, see ``rerank``) the best entry is the nearest of the three closest."""
    token = F.regexp_extract_all(col(text_col), F.lit(f"({TOKEN_PATTERN})"), 1)
    toks = texts.select(col(id_col).alias("_id"), F.posexplode(token).alias("pos", "w"))
    best = fuzzy_match(toks.select("w"), vocabulary, "w", vocab_col, threshold, 3 if vectors else 1)
    best = (rerank(best, *vectors) if vectors else best).select("token", "match")
    names = (vocabulary.select(F.trim(col(vocab_col)).alias("name")).groupBy(F.lower("name").alias("match"))
             .agg(F.min("name").alias("name")))
    found = (toks.withColumn("token", F.lower("w")).join(best, "token").join(names, "match")
             .groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("_new")))
    between = F.split(col(text_col), TOKEN_PATTERN)
    new = F.transform(token, lambda w, i: F.coalesce(F.element_at("_new", i), w))
    text = F.array_join(F.flatten(F.zip_with(between, new, lambda s, w: F.array(s, F.coalesce(w, F.lit(""))))), "")
    return (texts.join(found, col(id_col) == F.col("_id"), "left")
            .select(col(id_col), F.when(F.col("_new").isNull(), col(text_col)).otherwise(text).alias("corrected")))


# ---------------------------------------------------------------- R3, R4

# Routing keywords and detector names.
QT_WORDS = ["select", "sort", "group", "avg", "median", "sum", "correlation", "rolling", "top"]
ANOMALY_WORDS = ["anomaly", "outlier", "eif", "lof", "inne", "ocsvm", "autoencoder", "ae"]
DETECTORS = ["EIF", "AE", "LOF", "COPOD", "INNE", "OCSVM"]
# A file path: characters that neither separate nor quote, ending in ".csv" in any case.
CSV_PATH = r"([^\s'\"`()<>{},;=]+\.[cC][sS][vV])\b"
# Names under which an EIF parameter may be given.
EIF_NAMES = {"ndim": ("n", "ndim"), "sample_size": ("ss", "sample_size"), "ntrees": ("t", "trees", "ntrees"),
             "scoring_metric": ("metric", "scoring_metric")}
EIF_CALL = r"\beif\s*\(([^()]*)\)"
NAMED_VALUE = r"([a-z_]+)\s*=\s*([^\s,;=]+)"


def _path(text):
    """The first CSV path of the text; the pattern runs only where the ending occurs."""
    return F.when(F.instr(F.lower(text), ".csv") == 0, "").otherwise(F.regexp_extract(text, CSV_PATH, 1))


def keyword_tags(df: DataFrame, text_col: str, substring: bool = False) -> DataFrame:
    """Adds ``need_qt``, ``need_anomaly``, ``algorithms`` (array) and ``csv_path``.
    Word-bounded matching by default; ``substring=True`` is the reference rule."""
    t = F.lower(col(text_col))
    words = "_words"
    while words in df.columns:
        words = "_" + words
    if substring:
        def has(word):
            return F.instr(t, word) > 0
    else:  # the text is cut into words once, and every flag looks its words up there
        def has(word):
            return F.array_contains(words, word)

        df = df.withColumn(words, F.split(t, "[^a-z0-9_]+"))
    qt, an = (reduce(lambda x, y: x | y, [has(w) for w in listed]) for listed in (QT_WORDS, ANOMALY_WORDS))
    algos = F.array_compact(F.array(*[F.when(has(a.lower()), F.lit(a)) for a in DETECTORS]))
    return df.withColumns({"need_qt": qt, "need_anomaly": an, "algorithms": algos, "csv_path": _path(col(text_col))}).drop(words)


def extract_params(df: DataFrame, text_col: str) -> DataFrame:
    """Parameters of the first ``EIF(name=value, ...)`` of the text as typed columns, NULL
    if absent; of several values for one parameter the last holds. ``csv_path``: first path."""
    call = F.regexp_extract(F.lower(col(text_col)), EIF_CALL, 1)
    given = F.arrays_zip(F.regexp_extract_all(call, F.lit(NAMED_VALUE), 1).alias("name"),
                         F.regexp_extract_all(call, F.lit(NAMED_VALUE), 2).alias("value"))

    def last(names):
        return F.try_element_at(F.filter(given, lambda g: g["name"].isin(*names)), F.lit(-1))["value"]

    value = {key: last(names) for key, names in EIF_NAMES.items()}
    return df.withColumns({
        "csv_path": _path(col(text_col)), "ndim": value["ndim"].try_cast("int"),
        "sample_size": value["sample_size"], "ntrees": value["ntrees"].try_cast("int"),
        "scoring_metric": value["scoring_metric"]})


# ---------------------------------------------------------------- R5

ACTION_SCHEMA = ("function string, args map<string,string>, "
                 "actions array<struct<function:string, args:map<string,string>>>, finish string, "
                 "_corrupt string")
# Argument-key aliases folded onto canonical names.
ARG_ALIASES = {"col": "column", "target": "target_column", "sort_by": "column", "by": "column",
               "group": "group_column", "group_by": "group_column", "cond": "condition", "expr": "formula"}


def outer_braces(c):
    """Text from the first ``{`` to the last ``}`` (NULL when either is missing)."""
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((first > 0) & (F.instr(c, "}") > 0) & (last >= first), c.substr(first, last - first + 1))


def parse_actions(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``raw_action`` (outer-brace slice) and ``action`` parsed with a fixed
    schema; unparsable slices keep their text in ``action._corrupt``. Argument keys
    are folded through ``ARG_ALIASES``; order words stay as given (see order.py)."""
    raw = outer_braces(col(text_col))
    parsed = F.from_json(raw, ACTION_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                                              "allowSingleQuotes": "false"})
    out = df.withColumn("raw_action", raw).withColumn("action", parsed)
    return out.withColumn("args", F.transform_keys(F.col("action.args"),
                                                   lambda k, v: F.coalesce(_alias_key(k), k)))


def _alias_key(k):
    expr = None
    for a, c in ARG_ALIASES.items():
        cond = F.lower(k) == F.lit(a)
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr
