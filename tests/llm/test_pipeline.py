"""The corpus pipeline: its stages, what each keeps, and its result against the stages by hand."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order_and_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_copies", "surrogates", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < out.count() <= before
        if name == "surrogates":
            assert out.count() == before
        docs, before = out, out.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(packed)
