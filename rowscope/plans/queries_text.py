"""Registered queries for the text and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscope.detect import features as M
from rowscope.operators import text as X
from rowscope.plans.catalog import query, r6, t

_TOK = X.TOKEN_PATTERN


def _emb(spark, sf):
    return M.from_array(t(spark, sf, "embeddings"), "vec_id", "embedding", label=F.col("label") == 0)


@query("retrieval_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.x, d.x) AS sim
      FROM e q, e d WHERE q.label = 0)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM s)
WHERE rank <= 8""")
def _r1(spark, sf):
    fm = _emb(spark, sf)
    return r6(X.retrieve_topk(fm.select("row_id", "x"), fm.where(F.col("y") == 1).select("row_id", "x"), k=8))


# Names with one letter lost, so that close matches exist: the words of all parts.
_WORDS_SQL = "(SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)"
_FUZZY_SQL = """fp AS (SELECT token, match, 1.0 - levenshtein(token, match) / greatest(length(token), length(match)) AS sim
       FROM l, r),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY sim DESC, match) AS rank
                      FROM fp WHERE sim >= 0.8 - 1e-12) WHERE rank <= 3)"""


def _words(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))


@query("fuzzy_match", f"""
WITH w AS {_WORDS_SQL},
l AS (SELECT DISTINCT lower(trim(substr(w, 1, length(w) - 1))) AS token FROM w WHERE length(w) > 1),
r AS (SELECT DISTINCT lower(trim(w)) AS match FROM w WHERE length(trim(w)) > 0), {_FUZZY_SQL}
SELECT token, match, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM fz""")
def _r2(spark, sf):
    w = _words(spark, sf)
    left = w.select(F.expr("substr(w, 1, length(w) - 1)").alias("w"))
    return r6(X.fuzzy_match(left, w, "w", "w", 0.8, 3))


# Vectors of names for the re-rank: how often each letter occurs.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VECTOR_SQL = "list_transform(string_split('" + _LETTERS + "', ''), lambda c: cast(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"


def _letter_counts(names, name):
    counts = [(F.length(name) - F.length(F.replace(F.col(name), F.lit(c), F.lit("")))).cast("double") for c in _LETTERS]
    return names.select(name).distinct().withColumn("x", F.array(*counts))


@query("fuzzy_rerank", f"""
WITH w AS {_WORDS_SQL},
l AS (SELECT DISTINCT lower(trim(substr(w, 2))) AS token FROM w WHERE length(w) > 1),
r AS (SELECT DISTINCT lower(trim(w)) AS match FROM w WHERE length(trim(w)) > 0),
fp AS (SELECT token, match, 1.0 - levenshtein(token, match) / greatest(length(token), length(match)) AS sim FROM l, r),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY sim DESC, match) AS rank
                      FROM fp WHERE sim >= 0.5 - 1e-12) WHERE rank <= 3),
c AS (SELECT *, round(list_cosine_similarity({_VECTOR_SQL.format("token")}, {_VECTOR_SQL.format("match")}), 9) AS cosine FROM fz)
SELECT token, match, round(sim, 6) AS sim, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY cosine DESC NULLS LAST, rank) AS best FROM c) WHERE best = 1""")
def _r2_rerank(spark, sf):
    """Names without their first letter against all names; the nearest of the three closest by letter counts."""
    w = _words(spark, sf)
    left = w.select(F.expr("substr(w, 2)").alias("w"))
    close = X.fuzzy_match(left, w, "w", "w", 0.5, 3)
    return r6(X.rerank(close, _letter_counts(left.select(F.lower(F.trim("w")).alias("token")), "token"),
                       _letter_counts(w.select(F.lower(F.trim("w")).alias("match")), "match")))


# One expression for both engines: a request with a misspelt name, numbers and operators.
_REQUEST = ("concat('Sort by ', substr(p_name, 1, length(split_part(p_name, ' ', 1)) - 1), ' > ', p_partkey, ', then (', "
            "split_part(p_name, ' ', 2), ') top 5!')")


@query("correct_tokens", f"""
WITH w AS {_WORDS_SQL}, req AS (SELECT p_partkey, {_REQUEST} AS text FROM part),
toks AS (SELECT p_partkey, unnest(a) AS w, unnest(s[1:len(a)]) AS sep, unnest(range(1, len(a) + 1)) AS pos
         FROM (SELECT p_partkey, regexp_extract_all(text, '{_TOK}') AS a, string_split_regex(text, '{_TOK}') AS s FROM req)),
l AS (SELECT DISTINCT lower(w) AS token FROM toks),
r AS (SELECT DISTINCT lower(trim(w)) AS match FROM w WHERE length(trim(w)) > 0), {_FUZZY_SQL},
rep AS (SELECT p_partkey, string_agg(sep || coalesce(upper(fz.match), toks.w), '' ORDER BY pos) AS head
        FROM toks LEFT JOIN fz ON lower(toks.w) = fz.token AND fz.rank = 1 GROUP BY p_partkey)
SELECT req.p_partkey, coalesce(head, '') || string_split_regex(text, '{_TOK}')[-1] AS corrected
FROM req LEFT JOIN rep USING (p_partkey)""")
def _r2b(spark, sf):
    requests = t(spark, sf, "part").select("p_partkey", F.expr(_REQUEST).alias("text"))
    names = _words(spark, sf).select(F.upper("w").alias("w"))
    return X.correct_tokens(requests, "p_partkey", "text", names, "w", 0.8)


def _kw(word):
    return f"regexp_matches(lower(text), '(^|[^a-z0-9_]){word}([^a-z0-9_]|$)')"


def _case(value: str, words: list[str], other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + f" ELSE '{other}' END"


# One expression for both engines: requests composed from all lineitem rows, in which every
# keyword, detector, path form and parameter name occurs, beside words that only contain one.
_CHAT = ("concat(" + _case("l_orderkey % 12", [*X.QT_WORDS, "preselected"], "show") + ", ' rows, ', "
         + _case("(l_orderkey + l_linenumber) % 11", [*X.ANOMALY_WORDS, "Copod", "eiffel"], "plain")
         + ", ' in ', CASE l_suppkey % 4 WHEN 0 THEN concat('data/run', l_partkey, '.csv') "
         "WHEN 1 THEN concat('(dir', l_partkey, '/b-1.CSV)') WHEN 2 THEN 'a.csvx' ELSE 'no file' END, "
         "CASE l_partkey % 5 WHEN 0 THEN concat('; EIF(n=', l_linenumber, ', ss=', l_suppkey, ', t=', l_partkey, ', metric=density)') "
         "WHEN 1 THEN concat('; eif ( ndim = ', l_linenumber, ' , sample_size=auto, ntrees=', l_partkey, ', trees=9, scoring_metric=depth )') "
         "WHEN 2 THEN '; EIF(ntrees=many)' WHEN 3 THEN '; Eif()' ELSE '' END)")
_CHAT_SQL = f"(SELECT l_orderkey, l_linenumber, {_CHAT} AS text FROM lineitem)"
_PATH_SQL = X.CSV_PATH.replace("'", "''")


def _chat(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CHAT).alias("text"))


@query("keyword_tags", f"""
SELECT l_orderkey, l_linenumber,
       ({' OR '.join(_kw(w) for w in X.QT_WORDS)}) AS need_qt,
       ({' OR '.join(_kw(w) for w in X.ANOMALY_WORDS)}) AS need_anomaly,
       concat_ws(',', {', '.join(f"CASE WHEN {_kw(a.lower())} THEN '{a}' END" for a in X.DETECTORS)}) AS algorithms,
       regexp_extract(text, '{_PATH_SQL}', 1) AS csv_path
FROM {_CHAT_SQL}""")
def _r3(spark, sf):
    out = X.keyword_tags(_chat(spark, sf), "text")
    return out.select("l_orderkey", "l_linenumber", "need_qt", "need_anomaly",
                      F.array_join("algorithms", ",").alias("algorithms"), "csv_path")


def _param(key):
    names = ", ".join(f"'{n}'" for n in X.EIF_NAMES[key])
    return f"list_filter(list_zip(names, vals), lambda p: p[1] IN ({names}))[-1][2]"


@query("extract_params", f"""
WITH c AS (SELECT *, regexp_extract(lower(text), '{X.EIF_CALL}', 1) AS call FROM {_CHAT_SQL}),
p AS (SELECT *, regexp_extract_all(call, '{X.NAMED_VALUE}', 1) AS names, regexp_extract_all(call, '{X.NAMED_VALUE}', 2) AS vals FROM c)
SELECT l_orderkey, l_linenumber, regexp_extract(text, '{_PATH_SQL}', 1) AS csv_path, TRY_CAST({_param('ndim')} AS INTEGER) AS ndim,
       {_param('sample_size')} AS sample_size, TRY_CAST({_param('ntrees')} AS INTEGER) AS ntrees,
       {_param('scoring_metric')} AS scoring_metric
FROM p""")
def _r4(spark, sf):
    out = X.extract_params(_chat(spark, sf), "text")
    return out.select("l_orderkey", "l_linenumber", "csv_path", "ndim", "sample_size", "ntrees", "scoring_metric")


# One expression for both engines: replies of every kind, whole and broken, from all lineitem rows.
_REPLY = ("CASE l_orderkey % 7 "
          "WHEN 0 THEN concat('Sure: {\"function\": \"top_n\", \"args\": {\"n\": \"', l_linenumber, '\", \"col\": \"q', l_partkey, '\"}} done') "
          "WHEN 1 THEN concat('{\"function\": \"group_top_n\", \"args\": {\"group\": \"s', l_suppkey, '\", \"sort_by\": \"l_tax\"}}') "
          "WHEN 2 THEN concat('{\"function\": \"select_rows\", \"args\": {\"cond\": \"x > ', l_linenumber, '\", \"target\": \"y\"}}') "
          "WHEN 3 THEN '{\"finish\": \"done\"}' "
          "WHEN 4 THEN concat('{\"function\": \"broken ', l_orderkey, '}') "
          "WHEN 5 THEN '} nothing {' ELSE concat('no braces ', l_orderkey) END")
_REPLY_SQL = f"(SELECT l_orderkey, l_linenumber, {_REPLY} AS text FROM lineitem)"
_SLICE_SQL = """CASE WHEN strpos(text, '{') > 0 AND strpos(text, '}') > 0
                      AND length(text) - strpos(reverse(text), '}') + 1 >= strpos(text, '{')
                     THEN substr(text, strpos(text, '{'), length(text) - strpos(reverse(text), '}') + 1 - strpos(text, '{') + 1) END"""


def _replies(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_REPLY).alias("text"))


@query("action_slice", f"SELECT l_orderkey, l_linenumber, {_SLICE_SQL} AS raw_action FROM {_REPLY_SQL}")
def _r5(spark, sf):
    return X.parse_actions(_replies(spark, sf), "text").select("l_orderkey", "l_linenumber", "raw_action")


def _arg(*names):
    return "coalesce(" + ", ".join(f"json_extract_string(j, '$.args.{n}')" for n in names) + ")"


@query("action_parse", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {_SLICE_SQL} AS raw FROM {_REPLY_SQL}),
v AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS j FROM s)
SELECT l_orderkey, l_linenumber, json_extract_string(j, '$.function') AS function, json_extract_string(j, '$.finish') AS finish,
       {_arg('n', 'n')} AS arg_n, {_arg('column', 'col', 'sort_by')} AS arg_column,
       {_arg('group_column', 'group')} AS arg_group_column, {_arg('condition', 'cond')} AS arg_condition,
       {_arg('target_column', 'target')} AS arg_target_column, raw IS NOT NULL AND j IS NULL AS corrupt
FROM v""")
def _r5b(spark, sf):
    out = X.parse_actions(_replies(spark, sf), "text")
    names = ("n", "column", "group_column", "condition", "target_column")
    return out.select("l_orderkey", "l_linenumber", F.col("action.function").alias("function"), F.col("action.finish").alias("finish"),
                      *[F.try_element_at("args", F.lit(n)).alias(f"arg_{n}") for n in names],
                      F.coalesce(F.col("action._corrupt").isNotNull(), F.lit(False)).alias("corrupt"))
