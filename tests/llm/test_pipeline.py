"""The pipeline's stages on inputs with nulls, repeats and clashing names, and as a whole against what it must keep."""

import shutil

import corpus_pipeline
from zonegrain.llm import jaccard_join


def test_stages_nasty(spark, nasty, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (nasty, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_run(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = corpus_pipeline.good(spark, docs, data)
    one = corpus_pipeline.distinct(spark, good, data)
    assert one.count() == good.select("text").distinct().count() == one.select("text").distinct().count()
    unlike = corpus_pipeline.unlike(spark, one, data)
    assert unlike.count() == jaccard_join.join(one).select("component_id").distinct().count()
    pieces = corpus_pipeline.run(spark, data)
    kept = corpus_pipeline.mixed(spark, unlike, data)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in kept.collect()}
    shutil.rmtree(tmp_path, ignore_errors=True)
