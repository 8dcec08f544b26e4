"""Registered queries for ordered sequences, intervals, graph and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscope.operators import graph as G
from rowscope.operators import intervals as I
from rowscope.operators import sequence as W
from rowscope.operators import setops as U
from rowscope.plans.catalog import query, r6, t
from rowscope.plans.ordering import prefix_sums, row_index


@query("rolling_average", """
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_rollavg_3
FROM events""")
def _w1(spark, sf):
    ev = t(spark, sf, "events")
    out = W.rolling_average(ev, "user_id", "value", order_by=["ts", "event_id"], window=3, block_rows=1000)
    return r6(out.select("event_id", "user_id", "value_rollavg_3"))


@query("smooth_centered", """
WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER () AS n FROM events),
edge AS (SELECT arg_min(value, i) AS x0, arg_max(value, i) AS xl FROM o)
SELECT event_id, i AS row_idx,
       round((sum(value) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
              + greatest(0, 2 - i) * x0 + greatest(0, i + 2 - (n - 1)) * xl) / 5, 6) AS value_smooth_5
FROM o, edge""")
def _w2(spark, sf):
    ev = t(spark, sf, "events").select("event_id", "ts", "value")
    out = W.smooth(ev, "value", ["ts", "event_id"], k=5, block_rows=1000)
    return r6(out.select("event_id", "row_idx", "value_smooth_5"))


_WINDOWS_SQL = """
WITH o AS (SELECT value, user_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER () AS n FROM events),
w AS (SELECT i AS win_start FROM o WHERE i % 3 = 0 AND i <= n - 4)
SELECT w.win_start, flatten(list([o.value::DOUBLE, o.user_id::DOUBLE] ORDER BY o.i)) AS window
FROM w JOIN o ON o.i BETWEEN w.win_start AND w.win_start + 3 GROUP BY w.win_start"""


@query("sliding_windows", _WINDOWS_SQL)
def _w4(spark, sf):
    ev = t(spark, sf, "events")
    return W.make_windows(ev, ["value", "user_id"], ["ts", "event_id"], length=4, stride=3)


@query("window_scores_to_points", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER () AS n FROM events),
w AS (SELECT i AS win_start FROM o WHERE i % 3 = 0 AND i <= n - 4),
ws AS (SELECT w.win_start, max(o.value) AS score FROM w JOIN o ON o.i BETWEEN w.win_start AND w.win_start + 3
       GROUP BY w.win_start),
pts AS (SELECT o.i AS row_idx, avg(ws.score) AS m FROM o LEFT JOIN ws
        ON o.i BETWEEN ws.win_start AND ws.win_start + 3 GROUP BY o.i)
SELECT row_idx, round(coalesce(m, 0.0), 6) AS score FROM pts""")
def _w5(spark, sf):
    ev = t(spark, sf, "events")
    win = W.make_windows(ev, ["value"], ["ts", "event_id"], length=4, stride=3)
    scores = win.select("win_start", F.array_max("window").alias("score"))
    n = ev.count()
    return r6(W.windows_to_points(scores, n, 4))


# all pairs: many of these intervals end before they start
_IV = "SELECT o_orderdate AS s, l_shipdate AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _intervals(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    od = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return li.join(od, li.l_orderkey == od.o_orderkey)


@query("interval_events", f"""
WITH iv AS ({_IV})
SELECT s AS t, 1 AS delta FROM iv WHERE s IS NOT NULL
UNION ALL SELECT e AS t, -1 AS delta FROM iv WHERE e IS NOT NULL""")
def _u3(spark, sf):
    return I.interval_events(_intervals(spark, sf), "o_orderdate", "l_shipdate")


@query("concurrency", f"""
WITH iv AS ({_IV}),
ev AS (SELECT s AS t, 1 AS d FROM iv UNION ALL SELECT e AS t, -1 AS d FROM iv),
run AS (SELECT t, sum(d) OVER (ORDER BY t, d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
        FROM ev),
org AS (SELECT date_trunc('day', min(t)) AS o FROM ev),
b AS (SELECT CAST(floor(date_diff('microsecond', o, t) / 604800000000) AS BIGINT) AS k, avg(c) AS m
      FROM run, org GROUP BY 1),
allb AS (SELECT range AS k FROM range((SELECT min(k) FROM b), (SELECT max(k) FROM b) + 1)),
f AS (SELECT allb.k, last_value(b.m IGNORE NULLS) OVER (ORDER BY allb.k
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
      FROM allb LEFT JOIN b ON allb.k = b.k)
SELECT o + to_microseconds(k * 604800000000) AS bucket, round(v, 6) AS concurrent FROM f, org""")
def _t1(spark, sf):
    return r6(I.concurrency(_intervals(spark, sf), "o_orderdate", "l_shipdate", freq="7D"))


@query("graph_nodes", """
WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL)
SELECT 'M::' || l_suppkey AS node_id, 0 AS side, CAST(l_suppkey AS VARCHAR) AS label, count(*) AS degree
FROM p GROUP BY l_suppkey
UNION ALL
SELECT 'J::' || l_partkey, 1, CAST(l_partkey AS VARCHAR), count(*) FROM p GROUP BY l_partkey""")
def _g1(spark, sf):
    nodes, _ = G.bipartite(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")
    return nodes


@query("graph_edges", """
SELECT DISTINCT 'M::' || l_suppkey AS src, 'J::' || l_partkey AS dst FROM lineitem
WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL""")
def _g1b(spark, sf):
    _, edges = G.bipartite(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")
    return edges


@query("distinct_pairs", """
SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL""")
def _u2(spark, sf):
    return G.distinct_pairs(t(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("concat_frames", """
SELECT event_id, ts, value, NULL::BIGINT AS user_id, NULL::VARCHAR AS event_type FROM events WHERE value < 50
UNION ALL
SELECT event_id, NULL::TIMESTAMP, NULL::DOUBLE, user_id, event_type FROM events WHERE NOT (value < 50)""")
def _u1(spark, sf):
    ev = t(spark, sf, "events")
    a = ev.where(F.col("value") < 50).select("event_id", "ts", "value")
    b = ev.where(~(F.col("value") < 50)).select("event_id", "user_id", "event_type")
    return U.concat_frames([a, b])


@query("row_index_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS row_idx
FROM lineitem""")
def _idx(spark, sf):
    li = t(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return row_index(li, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_idx")


@query("rolling_average_global", """
SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6)
       AS value_rollavg_5
FROM events""")
def _z7(spark, sf):
    ev = t(spark, sf, "events")
    out = W.rolling_average(ev, None, "value", order_by=["ts", "event_id"], window=5, block_rows=1000)
    return r6(out.select("event_id", "value_rollavg_5"))


@query("running_sum_cut_groups", """
SELECT o_orderpriority, o_orderkey, cents,
       CAST(sum(cents) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS cum_cents,
       CAST(sum(cents) OVER (PARTITION BY o_orderpriority) AS BIGINT) AS all_cents
FROM (SELECT o_orderpriority, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""")
def _running(spark, sf):
    """Running sums whose groups are cut into several range pieces each."""
    o = t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return prefix_sums(o, "o_orderkey", ["cents"], ["o_orderpriority"], partitions=37, total_prefix="all_")
