"""Registered queries of the operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowscope.llm import (decontaminate, fingerprints, language, linededup, matching, neardup, passages, ppm, prefixtrie, quality, repair,
                          substrings, tokens)
from rowscope.llm._text import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, list_filter(string_split_regex(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
g AS (SELECT uid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT DISTINCT uid, i, n, item_id FROM g JOIN p USING (n, g)),
hw AS (SELECT uid, count(DISTINCT pos) AS n_hit
       FROM (SELECT uid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY uid),
hi AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT uid, item_id FROM h) GROUP BY uid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (uid) LEFT JOIN hi USING (uid)"""


@query("op9_benchmark_decontamination", DECONTAMINATION_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wu-Manber search of all benchmark windows in all documents."""
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"),
                                                            read(spark, sf_dir, "benchmark")))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document and its decoding."""
    return tokens.digest(read(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-ensemble quality score of every whole document."""
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op3_language_mixture")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture and main language of every whole document."""
    return language.languages(read(spark, sf_dir, "documents"))


@query("op5_ppm_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-matching and word-baseline scores of every whole document."""
    return ppm.corpus_scores(read(spark, sf_dir, "documents"))


@query("op4_weighted_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent-weighted-sampling fingerprints of every whole document and its edited text."""
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH d AS (SELECT doc_id, text, md5(text) AS key FROM documents),
t AS (SELECT key, any_value(text) AS text FROM d WHERE text IS NOT NULL GROUP BY key),
l AS (SELECT key, pos, regexp_replace(line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS line
      FROM (SELECT key, unnest(range(len(a))) AS pos, unnest(a) AS line
            FROM (SELECT key, string_split(text, chr(10)) AS a FROM t))),
k AS (SELECT key, pos, list_transform(string_split_regex(line, '[ \t\x0B\f\r]+'),
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l WHERE line <> ''),
f AS (SELECT key, pos, toks, len(toks) AS n, toks[1:3] AS lead, 10 AS need FROM k
      UNION ALL SELECT key, pos, toks, len(toks), toks[1:6], 2 FROM k WHERE len(toks) >= 10),
v AS (SELECT need, n, lead FROM f GROUP BY need, n, lead HAVING count(DISTINCT key) >= need),
o AS (SELECT f.* FROM f JOIN v ON f.need = v.need AND f.n = v.n AND f.lead = v.lead),
x AS (SELECT key, pos, need, n, lead, unnest(range(n)) AS place, unnest(toks) AS tok FROM o),
h AS (SELECT need, n, lead, place, tok FROM x WHERE tok <> '<*>' GROUP BY need, n, lead, place, tok HAVING count(*) >= need),
m AS (SELECT x.key, x.pos, x.need, x.n, x.lead, list(struct_pack(place := x.place, tok := x.tok) ORDER BY x.place) AS fixed
      FROM x JOIN h ON x.need = h.need AND x.n = h.n AND x.lead = h.lead AND x.place = h.place AND x.tok = h.tok
      GROUP BY x.key, x.pos, x.need, x.n, x.lead HAVING count(*) >= 0.6 * x.n AND (x.need = 10 OR count(*) >= 10)),
r AS (SELECT need, n, lead, fixed FROM m GROUP BY need, n, lead, fixed HAVING count(DISTINCT key) >= need),
p AS (SELECT DISTINCT m.key, m.pos FROM m JOIN r ON m.need = r.need AND m.n = r.n AND m.lead = r.lead AND m.fixed = r.fixed),
z AS (SELECT key, list(pos) AS gone FROM p GROUP BY key),
q AS (SELECT doc_id, text, coalesce(gone, []::BIGINT[]) AS gone, string_split(text, chr(10)) AS a
      FROM d LEFT JOIN z ON d.key = z.key),
c AS (SELECT doc_id, coalesce(len(a), 0) AS n_lines, len(gone) AS n_dropped,
             coalesce(array_to_string(list_filter(a, lambda e, i: NOT list_contains(gone, i - 1)), chr(10)), '') AS kept FROM q)
SELECT doc_id, cast(n_lines AS BIGINT) AS n_lines, cast(n_dropped AS BIGINT) AS n_dropped,
       cast(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM c"""


@query("op8_line_templates", LINE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of recurring templates dropped from every whole document."""
    return linededup.digest(read(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 200-byte strings removed from every whole document."""
    return substrings.digest(read(spark, sf_dir, "documents"))


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every whole document."""
    return neardup.groups(read(spark, sf_dir, "documents"))


@query("op6_compact_windows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def _crc(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: cast(ascii(x) AS BIGINT))), "
            "lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), "
            "lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


TRIE_SQL = f"""
WITH t AS (SELECT conv_id, d, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d, n) AS pos
      FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS n,
                   md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
            FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("cast(conv_id AS VARCHAR)")} % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, d, n FROM c JOIN t ON t.conv_id = base AND pos <= h
      UNION ALL SELECT c.conv_id, pos, d, n FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS k, n FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
m AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n,
             CASE WHEN depth > 0 THEN left(k, 32 * (depth - 1)) END AS up FROM p GROUP BY k, depth),
f AS (SELECT up, count(*) AS n_children FROM m WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN f ON f.up = m.k),
s AS (SELECT left(k, 32 * a) AS k, sum(leaf) AS n_leaves, sum(saving) AS saved_tokens
      FROM (SELECT k, unnest(range(depth + 1)) AS a, cast(n_children = 0 AS INT) AS leaf, (n_convs - 1) * n AS saving FROM v) GROUP BY 1),
e AS (SELECT k, string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT v.conv_id, v.depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children, cast(n_leaves AS BIGINT) AS n_leaves,
       cast(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s ON s.k = v.k LEFT JOIN m ON m.k = v.up LEFT JOIN e ON e.k = v.k"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefixtrie.prefix_trie(read(spark, sf_dir, "conversations"))


def _add(way: str, cost: int | str, letter: str) -> str:
    """A way (twelve digits of cost, then its audit) with one more edit."""
    return f"lpad(cast(cast(left({way}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({way}, 13) || '{letter}'"


_INSERTED = (f"[x[1], x[2], least(x[3], {_add('least(x[1], x[2], x[4])', 5, 'I')}), "
             f"least(x[4], {_add('x[3]', 5, 'I')}, {_add('least(x[1], x[2])', 10, 'II')})]")
_EDITED = (f"[{_add('x[1]', 2, 'D')}, least({_add('x[2]', 2, 'D')}, CASE WHEN y[1] = 's' THEN {_add('x[1]', 'cast(y[2] AS BIGINT)', 'K')} END), "
           f"least({_add('x[3]', 2, 'D')}, CASE WHEN y[1] = 'u' THEN {_add('least(x[1], x[2], x[4])', 'cast(y[2] AS BIGINT)', 'K')} END, "
           f"CASE WHEN y[1] <> 'x' THEN {_add('least(x[1], x[2], x[4])', '1 + cast(y[2] AS BIGINT)', 'R')} END), "
           f"least({_add('x[4]', 2, 'D')}, CASE WHEN y[1] = 'a' THEN {_add('x[3]', 'cast(y[2] AS BIGINT)', 'K')} END, "
           f"CASE WHEN y[1] <> 'x' THEN {_add('x[3]', '1 + cast(y[2] AS BIGINT)', 'R')} END)]")
REPAIR_SQL = f"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {_crc("coalesce(cast(conv_id AS VARCHAR), ' ') || ':' || coalesce(cast(turn AS VARCHAR), ' ')")} % 20 AS hurt
           FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN hurt = 1 THEN '' WHEN hurt = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN hurt = 3 THEN 2 ELSE 1 END)) AS again
      FROM o WHERE hurt <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS pos,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth,
             regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS bare FROM d),
g AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
             CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated'
                  ELSE 'none' END AS fault FROM w),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal,
             list([CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'o' END,
                   CASE WHEN fault = 'truncated' THEN '5' ELSE '0' END] ORDER BY pos) AS syms
      FROM g GROUP BY conv_id),
b AS (SELECT *, list_reduce(list_concat([['000000000000', '100000000000', '100000000000', '100000000000'], ['I']],
             flatten(list_transform(syms, lambda s: [s, ['I']]))),
             lambda x, y: CASE WHEN y[1] = 'I' THEN {_INSERTED} ELSE {_EDITED} END) AS ways FROM a),
z AS (SELECT * EXCLUDE (syms, ways), cast(left(least(ways[1], ways[4]), 12) AS BIGINT) AS cost, substr(least(ways[1], ways[4]), 13) AS audit FROM b),
u AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS i, substr(audit, i, 1) AS x FROM z),
q AS (SELECT conv_id, i, x, sum(cast(x <> 'I' AS INT)) OVER h AS pos, sum(cast(x <> 'D' AS INT)) OVER h AS nr
      FROM u WINDOW h AS (PARTITION BY conv_id ORDER BY i)),
k AS (SELECT q.*, g.role, g.text, max(CASE WHEN nr = 1 AND x = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS led
      FROM q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.pos = q.pos AND x <> 'I' WHERE x <> 'D'),
l AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN (nr - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
             || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body FROM k GROUP BY conv_id)
SELECT c.conv_id, cast(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repaired(read(spark, sf_dir, "conversations"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document by longest matches, and its decoding."""
    return matching.digest(read(spark, sf_dir, "documents"))
