"""The pipeline's stages on a small corpus, each against its operator's own decisions."""

import corpus_pipeline
from strandlake.llm import rules, simhash


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash", "mixing", "packing"]
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, sf), "test")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "quality rules":
            assert {r[0] for r in docs.select("doc_id").collect()} == {r["id"] for r in rules.quality_rules(before).where("kept").collect()}
        if name == "simhash":
            assert docs.count() == simhash.simhash_components(before).select("component_id").distinct().count()
    assert docs.count() > 0 and docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
