"""The corpus pipeline at small scale."""

import corpus_pipeline
from recurra.llm import decontaminate, nearcopies


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    after = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(after) < len(before) and set(after) <= set(before)
    assert nearcopies.near_copies(docs).count() == 0
    assert decontaminate.leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert not any("@mail" in r.text for r in after.values())
    mixed = corpus_pipeline.run(spark, data)
    assert mixed.count() == len(after)
