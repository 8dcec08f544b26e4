"""CSV ingest rules, action lists, plan shape and streaming scoring."""

import os

from pyspark.sql import functions as F

from rowscope.operators import filters as P
from rowscope.operators import order as O
from rowscope.plans.actions import run_actions
from rowscope.sources.csv import clean_names, read_csv, read_csv_dir, sniff_delimiter
from rowscope.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_csv_rules(spark, tmp_path):
    d = tmp_path / "runs"
    (d / "valve1").mkdir(parents=True)
    (d / "other").mkdir()
    (d / "valve1" / "a.csv").write_text("datetime;Sensor A;anomaly\n2020-01-01 00:00:00;1.5;0\nbad;2.5;1\n")
    (d / "other" / "b.csv").write_text("datetime,Sensor A,Sensor B\n2020-01-02 00:00:00,3.0,4.0\n")
    assert sniff_delimiter("a;b;c,d") == ";"
    assert clean_names([" datetime", "Sensor A"]) == ["time_stamp", "Sensor_A"]
    one = read_csv(spark, str(d / "valve1" / "a.csv"))
    assert one.columns == ["time_stamp", "Sensor_A", "anomaly"]
    assert one.where(F.col("time_stamp").isNull()).count() == 1
    both = read_csv_dir(spark, str(d))
    rows = {r["group"]: r for r in both.collect() if r["time_stamp"] is not None}
    assert set(both.columns) >= {"time_stamp", "Sensor_A", "Sensor_B", "anomaly", "group", "source_file"}
    assert rows["other"]["Sensor_A"] == 3.0 and rows["other"]["Sensor_B"] == 4.0
    assert rows["valve1"]["Sensor_A"] == 1.5 and rows["valve1"]["Sensor_B"] is None


def test_action_list(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    res = run_actions(li, {"actions": [
        {"function": "select_rows", "args": {"condition": "l_quantity > 10"}},
        {"function": "calculate_average", "args": {"target_column": "l_quantity"}},
        {"function": "sort_rows", "args": {"by": "l_extendedprice", "order": "降序"}},
        {"function": "top_n", "args": {"n": 3, "pair": ["l_orderkey", "l_extendedprice"]}},
        {"finish": "done"}]})
    assert res.finish == "done"
    assert res.cursor.columns == ["l_orderkey", "l_extendedprice"] and res.cursor.count() == 3
    name, mean = res.side[0]
    exp = li.where("l_quantity > 10").agg(F.avg("l_quantity")).first()[0]
    assert name == "calculate_average" and abs(mean.first()["mean"] - exp) < 1e-9


def test_plans_push_down_and_group_limit(spark):
    li = read_table(spark, SF_SMALL, "lineitem")
    plan = P.select_rows(li, "l_quantity > 30").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,30.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        g = O.group_top_n(li, "l_suppkey", "l_extendedprice", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in g


def test_stream_scoring(spark, tmp_path):
    from rowscope.detect import features as M
    from rowscope.detect import inne
    from rowscope.streaming.scoring import score_stream

    emb = read_table(spark, SF_SMALL, "embeddings")
    model = inne.fit(M.from_array(emb, "vec_id", "embedding"), 20, 64)
    src = str(tmp_path / "in")
    emb.withColumn("ts", F.current_timestamp()).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    scored = score_stream(stream, model, "vec_id", "ts", array_col="embedding")
    q = scored.writeStream.format("memory").queryName("scored_stream").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.sql("SELECT * FROM scored_stream")
    assert out.count() == emb.count()
    assert out.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert os.path.isdir(src)


def test_entry_works_from_another_directory(tmp_path):
    """Python workers must import the package even when the driver starts elsewhere."""
    import subprocess
    import sys
    import textwrap

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__ as e
        df = e.queries()["inne_scores"](spark, {SF_SMALL!r})
        print("ROWS", df.count())
    """)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 500" in out.stdout, out.stderr[-2000:]
