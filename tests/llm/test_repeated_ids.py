"""Ids that come again with another text."""

import corpus_pipeline
from zonegrain.llm import exact_dedup


def test_text_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.survivors(docs).collect()), key=str)
    assert got == [(5, "B"), (9, "A"), (None, "C")]


def test_stages_drop_rows_and_not_ids(spark, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(5, copy, "en"), (5, "quite another text of its own kind", "en"), (3, copy + " more", "en"), (None, copy + " less", "en"), (None, "alone with no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = corpus_pipeline.unlike(spark, docs, str(tmp_path))
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
    drawn = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    assert {tuple(r) for r in drawn} <= set(rows)
