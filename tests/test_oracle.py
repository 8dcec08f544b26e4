"""Registered queries vs their DuckDB SQL on the smallest scale (the driver runs all at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.oracle_check import digest
from rowscope.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST = ["select_rows_expr", "select_rows_duration", "filter_time_between", "derived_time_diff",
        "derived_expression", "delay_avg_grouped", "sort_rows_position", "top_n", "group_top_n",
        "group_agg_multi_agg", "group_agg_first_last", "median", "mode", "percentile_grouped", "correlation",
        "failure_rate", "rolling_average", "smooth_centered", "sliding_windows", "concurrency", "graph_nodes",
        "row_index_lineitem", "standard_scale", "copod_leaderboard", "eval_metrics", "pr_curve",
        "roc_auc_trapezoid", "score_thresholds", "knn_manhattan", "lof_scores", "retrieval_topk",
        "fuzzy_match", "keyword_tags", "extract_params", "action_slice"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["algo", "precision", "recall", "f1", "pr_auc", "roc_auc"]
    assert len(rows) == 1 and 0 <= rows[0]["pr_auc"] <= 1
