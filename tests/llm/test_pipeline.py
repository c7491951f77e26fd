"""Each stage of the pipeline on its own input, and the packed result."""

import corpus_pipeline
from lexigrain.llm import common


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = common.stage(stage(spark, docs, sf), "t")
        assert docs.columns == names, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
