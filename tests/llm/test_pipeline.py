"""The pipeline's stages: decisions take effect, columns stay, and the parts of the repository stand alone."""

import duckdb

import corpus_pipeline
from rowscope.llm import decontaminate, neardup, quality, tokens
from tests.llm.conftest import SF
from tests.llm.test_tokens_bench_lines import library_rows


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
    assert kept[0] > kept[1] == kept[2] > kept[3] > kept[4] > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.where("quality = 1"), "doc_id").count() > 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.contamination(docs, bench)).collect())
    assert neardup.groups(spark.read.parquet(str(tmp_path / "near_dedup"))).where("n_texts > 1").count() == 0
    want = library_rows([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == tokens.digest(docs).columns
    assert sorted((tuple(r) for r in ran.collect()), key=str) == want


def test_first_stage_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, sf).select("doc_id").collect()}
    rows = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    good = [d for d, q in rows if q == 1]
    bad = [d for d, q in rows if q == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)
    assert quality.THRESHOLD == 0.3


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
