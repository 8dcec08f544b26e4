"""Registered queries for filters, projections, sorts and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowscope.operators import aggregate as A
from rowscope.operators import filters as P
from rowscope.operators import order as O
from rowscope.plans.catalog import LINE_ORDERS_SQL, line_orders, query, r6, t

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("select_rows_expr", """
SELECT * FROM lineitem
WHERE (l_quantity > 30 AND l_returnflag = 'R') OR l_discount >= 0.09""")
def _p1(spark, sf):
    return P.select_rows(t(spark, sf, "lineitem"),
                         '(l_quantity > 30 and l_returnflag == "R") or l_discount >= 0.09')


@query("select_rows_ne_keep_missing", """
SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'""")
def _p1b(spark, sf):
    return P.select_rows(t(spark, sf, "customer"), "c_mktsegment != 'BUILDING'",
                         missing_matches_ne=True)


@query("select_rows_all", "SELECT * FROM part")
def _p2(spark, sf):
    return P.select_rows(t(spark, sf, "part"), "all")


@query("select_rows_duration", f"""
SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM {LINE_ORDERS_SQL}
WHERE date_diff('microsecond', o_orderdate, l_shipdate) >= 36.5 * 3600 * 1e6""")
def _p3(spark, sf):
    df = line_orders(spark, sf)
    return P.select_rows(df, "l_shipdate - o_orderdate >= 36.5 hours").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate")


@query("filter_time_between", """
SELECT * FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-12-31 00:00:00'""")
def _p4(spark, sf):
    return P.filter_time_between(t(spark, sf, "orders"), "o_orderdate", "1996-01-01 00:00:00",
                                 "1996-12-31 00:00:00", inclusive="left")


@query("select_columns", "SELECT p_name, p_partkey FROM part")
def _p5(spark, sf):
    return P.select_columns(t(spark, sf, "part"), "p_name, p_partkey")


@query("derived_time_diff", f"""
SELECT l_orderkey, l_linenumber,
       round(date_diff('microsecond', o_orderdate, l_shipdate) / 3.6e9, 6) AS lead_hours
FROM {LINE_ORDERS_SQL}""")
def _p6(spark, sf):
    df = P.add_derived_column(line_orders(spark, sf), "lead_hours", "l_shipdate - o_orderdate", unit="hours")
    return r6(df.select("l_orderkey", "l_linenumber", "lead_hours"))


@query("derived_expression", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END, 6) AS per_discount,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge
FROM lineitem""")
def _p7(spark, sf):
    df = P.add_derived_column(t(spark, sf, "lineitem"), "per_discount", "l_extendedprice / l_discount",
                              safe=True)
    df = P.add_derived_column(df, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return r6(df.select("l_orderkey", "l_linenumber", "per_discount", "charge"))


@query("delay_rows", f"""
SELECT l_orderkey, l_linenumber, round(date_diff('microsecond', o_orderdate, l_shipdate) / 6e7, 6) AS delay
FROM {LINE_ORDERS_SQL}""")
def _p8(spark, sf):
    rows, _ = P.delay(line_orders(spark, sf), "l_shipdate", "o_orderdate")
    return r6(rows.select("l_orderkey", "l_linenumber", "delay"))


@query("delay_avg", f"""
SELECT round(avg(date_diff('microsecond', o_orderdate, l_shipdate) / 6e7), 6) AS avg_delay
FROM {LINE_ORDERS_SQL}""")
def _p8b(spark, sf):
    _, mean = P.delay(line_orders(spark, sf), "l_shipdate", "o_orderdate")
    return r6(mean)


@query("delay_avg_grouped", f"""
SELECT o_orderpriority, round(avg(date_diff('microsecond', o_orderdate, l_shipdate) / 6e7), 6) AS avg_delay
FROM {LINE_ORDERS_SQL} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def _p9(spark, sf):
    _, mean = P.delay(line_orders(spark, sf), "l_shipdate", "o_orderdate", group_column="o_orderpriority")
    return r6(mean)


@query("sort_rows_position", """
SELECT *, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey) - 1 AS pos FROM part""")
def _o1(spark, sf):
    return O.sort_rows(t(spark, sf, "part"), "p_retailprice", "desc", tiebreak=["p_partkey"], position="pos")


@query("sort_rows_events_asc", """
SELECT event_id, ts, value, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) - 1 AS pos
FROM events""")
def _o1b(spark, sf):
    df = t(spark, sf, "events").select("event_id", "ts", "value")
    return O.sort_rows(df, "value", "ascending", tiebreak=["event_id"], position="pos")


@query("top_n", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def _o2(spark, sf):
    return O.top_n(t(spark, sf, "lineitem"), 10, "l_extendedprice",
                   columns=["l_orderkey", "l_linenumber", "l_extendedprice"],
                   tiebreak=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("first_n_ordered", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 7")
def _o3(spark, sf):
    return O.top_n(t(spark, sf, "orders"), 7, order_by=["o_orderkey"])


@query("group_top_n", """
SELECT l_suppkey, l_extendedprice FROM lineitem WHERE l_suppkey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST,
                           l_orderkey, l_linenumber) <= 3""")
def _o4(spark, sf):
    return O.group_top_n(t(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", n=3,
                         keep_all=False, tiebreak=["l_orderkey", "l_linenumber"])


@query("group_top_n_keep_all", """
SELECT * FROM orders WHERE o_custkey IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice ASC NULLS LAST, o_orderkey) <= 2""")
def _o4b(spark, sf):
    return O.group_top_n(t(spark, sf, "orders"), "o_custkey", "o_totalprice", n=2, order="asc",
                         tiebreak=["o_orderkey"])


@query("preview")
def _o7(spark, sf):
    return O.preview(t(spark, sf, "lineitem"))


@query("group_agg_mean", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def _a1(spark, sf):
    return r6(A.group_by_aggregate(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "mean"))


@query("group_agg_multi_target", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS l_quantity,
       round(sum(l_extendedprice), 6) AS l_extendedprice
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def _a2(spark, sf):
    return r6(A.group_by_aggregate(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                                   ["l_quantity", "l_extendedprice"], "sum"))


@query("group_agg_multi_agg", """
SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean, round(sum(l_extendedprice), 6) AS sum,
       count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       round(stddev_samp(l_extendedprice), 6) AS std, round(var_samp(l_extendedprice), 2) AS var,
       round(median(l_extendedprice), 6) AS median, count(DISTINCT l_extendedprice) AS nunique,
       count(*) AS size, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS sem,
       round(skewness(l_extendedprice), 6) AS skew
FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey""")
def _a3(spark, sf):
    aggs = ["mean", "sum", "count", "min", "max", "std", "var", "median", "nunique", "size", "sem", "skew"]
    out = r6(A.group_by_aggregate(t(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", aggs))
    # the variance is ~1e9: 6 decimals would exceed double precision
    return out.withColumn("var", F.round("var", 2))


@query("group_agg_first_last", """
SELECT user_id, arg_min(value, ts) AS first, arg_max(value, ts) AS last
FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY user_id""")
def _a3b(spark, sf):
    return A.group_by_aggregate(t(spark, sf, "events"), "user_id", "value", ["first", "last"], order_by="ts")


@query("average", "SELECT round(avg(value), 6) AS mean FROM events")
def _a4(spark, sf):
    return r6(A.calculate_average(t(spark, sf, "events"), "value"))


@query("average_time_diff", f"""
SELECT round(avg(date_diff('microsecond', o_orderdate, l_shipdate) / 3.6e9), 6) AS mean FROM {LINE_ORDERS_SQL}""")
def _a5(spark, sf):
    return r6(A.calculate_average(line_orders(spark, sf), "l_shipdate - o_orderdate", unit="hours"))


@query("median", "SELECT round(quantile_cont(value, 0.5), 6) AS median FROM events")
def _a6(spark, sf):
    return r6(A.calculate_median(t(spark, sf, "events"), "value"))


@query("mode", """
SELECT l_quantity AS mode FROM (SELECT l_quantity, count(*) AS c FROM lineitem
WHERE l_quantity IS NOT NULL GROUP BY l_quantity) ORDER BY c DESC, l_quantity LIMIT 1""")
def _a7(spark, sf):
    return A.calculate_mode(t(spark, sf, "lineitem"), "l_quantity")


@query("sum", "SELECT round(coalesce(sum(value), 0), 6) AS sum FROM events")
def _a8(spark, sf):
    return r6(A.calculate_sum(t(spark, sf, "events"), "value"))


@query("min", "SELECT min(value) AS min FROM events")
def _a9(spark, sf):
    return A.calculate_min(t(spark, sf, "events"), "value")


@query("max", "SELECT max(value) AS max FROM events")
def _a10(spark, sf):
    return A.calculate_max(t(spark, sf, "events"), "value")


@query("std", "SELECT round(stddev_samp(value), 6) AS std FROM events")
def _a11(spark, sf):
    return r6(A.calculate_std(t(spark, sf, "events"), "value"))


@query("variance", "SELECT round(var_samp(value), 6) AS variance FROM events")
def _a12(spark, sf):
    return r6(A.calculate_variance(t(spark, sf, "events"), "value"))


@query("percentile", "SELECT round(quantile_cont(value, 0.9), 6) AS p90_value FROM events")
def _a13(spark, sf):
    return r6(A.calculate_percentile(t(spark, sf, "events"), "value", 90))


@query("percentile_zero", "SELECT round(quantile_cont(l_tax, 0.0), 6) AS p0_l_tax FROM lineitem")
def _a13b(spark, sf):
    return r6(A.calculate_percentile(t(spark, sf, "lineitem"), "l_tax", 0))


@query("percentile_grouped", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90_l_extendedprice
FROM lineitem WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_suppkey""")
def _a14(spark, sf):
    return r6(A.calculate_percentile(t(spark, sf, "lineitem"), "l_extendedprice", 90, group_by="l_suppkey"))


@query("correlation", """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def _a15(spark, sf):
    return r6(A.calculate_correlation(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("count_rows", "SELECT count(*) AS count FROM lineitem")
def _a16(spark, sf):
    return A.count_rows(t(spark, sf, "lineitem"))


@query("failure_rate", """
SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failure_rate
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def _a17(spark, sf):
    return r6(A.failure_rate(t(spark, sf, "events"), "user_id", "event_type", "error"))


@query("covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 6) AS covariance FROM lineitem")
def _a18(spark, sf):
    return r6(A.calculate_covariance(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query("group_mean_desc", """
SELECT l_suppkey, round(avg(l_extendedprice), 6) AS avg_l_extendedprice FROM lineitem
WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey""")
def _a19(spark, sf):
    return r6(A.group_mean_desc(t(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice"))


@query("events_value_skew", """
SELECT event_type, round(skewness(value), 6) AS value FROM events
WHERE event_type IS NOT NULL GROUP BY event_type""")
def _a1skew(spark, sf):
    return r6(A.group_by_aggregate(t(spark, sf, "events"), "event_type", "value", "skew"))


__all__ = ["F"]


@query("clip_text", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS clipped,
       length(text) AS n_chars_text
FROM documents""")
def _f10(spark, sf):
    from rowscope.functions.scalars import clip_text
    d = t(spark, sf, "documents")
    return d.select("doc_id", clip_text("text", 200, "...").alias("clipped"), F.length("text").cast("long").alias("n_chars_text"))


@query("grouped_correlation", """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS cor_l_quantity FROM lineitem
WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def _z8(spark, sf):
    return r6(A.grouped_pair_stat(t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", "corr"))


@query("grouped_covariance_keep_all", """
SELECT l_orderkey, l_linenumber, l_suppkey,
       round(covar_samp(l_quantity, l_tax) OVER (PARTITION BY l_suppkey), 6) AS cov_l_quantity
FROM lineitem""")
def _z8b(spark, sf):
    out = A.grouped_pair_stat(t(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "l_tax", "cov", keep_all=True)
    return r6(out.select("l_orderkey", "l_linenumber", "l_suppkey", "cov_l_quantity"))
