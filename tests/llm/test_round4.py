"""Batches of the substring operator."""

from weekwise.llm.registry import QUERIES

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_long_texts_travel_in_small_batches(spark, sf_dir):
    """Only where they are wanted: the next query has Spark's own batches again."""
    QUERIES["op2_substring_dedup"](spark, sf_dir)
    assert int(spark.conf.get(BATCH)) == 1000
    QUERIES["op6_quality_rules"](spark, sf_dir)
    assert int(spark.conf.get(BATCH)) == 10000
