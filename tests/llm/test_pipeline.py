import corpus_pipeline
from pyspark.sql import functions as F


def test_pipeline_runs_and_keeps_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.scratch_path(spark, name)
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "mixing" or docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.where((F.col("taken") <= 0) | (F.col("taken") > 3 * F.col("size"))).count() == 0
    assert docs.select("doc_id").distinct().count() == n


def test_pipeline_on_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0


def test_names_and_oracles_agree():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert "pipeline" in names and set(e.oracle_sql()) <= set(names)
