"""The pipeline's stages, the entry point, and the registered queries."""

import corpus_pipeline
from driftmap.llm import queries
from test_text_operators import SCHEMA, odd_rows

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.count() <= before.count()
        before = after
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() >= before.count()


def test_run_keeps_clean_documents(spark):
    packed = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(i in kept for i in good) > 0.8 * len(good)
    assert sum(i in kept for i in bad) < 0.3 * len(bad)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
