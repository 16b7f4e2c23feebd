"""The pipeline's stages on a small table, each against what its operator says of its own input."""

import pytest

import corpus_pipeline
from reelframe.llm import ngram_join, quality_classifier, quality_rules, suffix_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, SF)
    want = {r.doc_id for r in quality_classifier.scored(docs, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in one.collect()} == want and one.columns == columns
    from reelframe.llm.common import checkpointed

    one = checkpointed(one)
    two = checkpointed(stages[1](spark, one, SF))
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in quality_rules.assess(one).filter("kept").collect()}
    three = checkpointed(stages[2](spark, two, SF))
    assert {r.doc_id for r in three.collect()} == {r.component_id for r in ngram_join.grouped_documents(two).collect()}
    four = checkpointed(stages[3](spark, three, SF))
    assert four.columns == columns and four.count() == three.count()
    kept = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.digests(three).collect()}
    assert all(kept[r.doc_id] - 6 * 50 <= len(r.text.encode()) <= kept[r.doc_id] and r.n_chars == len(r.text) for r in four.collect())
    five = stages[4](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == set(kept)


def test_tasks_follow_the_data_through_checkpoints(spark, monkeypatch):
    from reelframe.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(common, "TASK_BYTES", 1 << 14)
    kept = common.checkpointed(docs.filter("doc_id >= 0"))
    texts = docs.selectExpr("sum(octet_length(text))").first()[0]
    held = common.input_bytes(kept)
    assert texts // 4 <= held <= 2 * texts  # checkpoints are compressed, as files are
    assert common.spread(kept) == (held + (1 << 14) - 1) >> 14
    assert common.spread(kept) > 4 and common.input_bytes(docs) // 4 <= held <= 4 * common.input_bytes(docs)
    joined = common.checkpointed(kept.join(docs.select("doc_id"), "doc_id"))
    assert common.input_bytes(joined) <= 2 * held  # measured, not the product of two sides
