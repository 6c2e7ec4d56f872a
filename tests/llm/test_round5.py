"""Batches of the jaccard join, and what a pipeline stage starts with."""

import corpus_pipeline as cp

from weekwise.llm.registry import QUERIES

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_sets_travel_in_small_batches(spark, sf_dir):
    QUERIES["op11_ngram_jaccard_join"](spark, sf_dir)
    assert int(spark.conf.get(BATCH)) == 1000


def test_a_stage_starts_without_what_earlier_ones_left(spark, monkeypatch):
    """Also where stages are called one by one, without `run`."""
    released = []
    monkeypatch.setattr(cp, "release", released.append)
    cp.stage(lambda spark, docs, sf_dir: released.append("stage"))(spark, None, "")
    assert released == [spark, "stage"]
    assert int(spark.conf.get(BATCH)) == 1000
