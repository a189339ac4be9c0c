"""Recall of op6 on toxic documents that it didn't learn from."""

from zonegrain.llm import toxicity


def test_toxic_held_out(spark):
    data = "/root/testdata/sf0.1"
    t = toxicity.op6_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out and toxic = 1").collect()
    assert len(t) > 50
    assert sum(r.predicted for r in t) / len(t) > 0.7
