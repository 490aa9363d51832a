"""The stages of the pipeline on the smallest tables."""

import corpus_pipeline
from nearmark.llm import quality
from nearmark.session import cut

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, DATA), f"test-{name}")
        held[name] = docs
        if name != "mix":
            assert docs.columns == before.columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    first = quality.with_features(held["quality"]).where("n_words < 50").count()
    assert first == 0
    for r in held["decontamination"].select("text").collect():
        assert not any(b in " ".join(r.text.lower().split()) for b in bench)
    assert held["secrets"].where("n_chars <> char_length(text)").count() == 0
    assert held["secrets"].where("text rlike '[0-9a-f]{24}'").count() == 0
    assert held["mix"].count() == held["secrets"].count()
    again = {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert again == {tuple(r) for r in held["mix"].collect()}
