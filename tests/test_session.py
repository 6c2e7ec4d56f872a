"""Settings that follow the size of the tables."""

from weekwise.plans.registry import QUERIES
from weekwise.session import PARTITION_BYTES, configure, for_tables, stored_bytes

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_partitions_grow_with_the_tables():
    """A partition's share of the stored bytes is bounded; small tables keep the least number."""
    assert for_tables(0)[PARTITIONS] == "200"
    for n_bytes in (1 << 30, 6 << 30):
        assert n_bytes / int(for_tables(n_bytes)[PARTITIONS]) <= PARTITION_BYTES


def test_size_of_stored_tables(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    files = sum(f.stat().st_size for f in (tmp_path / "t.parquet").iterdir() if not f.name.startswith("."))
    got = stored_bytes(spark, str(tmp_path / "t.parquet"), str(tmp_path / "missing.parquet"))
    assert files <= got <= files + 1000  # checksum files may count


def test_a_number_that_a_query_set_is_taken_back(spark, sf_dir):
    before = configure(spark).conf.get(PARTITIONS, None)
    configure(spark, for_tables(6 << 30))
    assert spark.conf.get(PARTITIONS) == "3072"
    QUERIES["week_calendar"](spark, sf_dir)
    assert spark.conf.get(PARTITIONS) == "200"
    assert configure(spark).conf.get(PARTITIONS, None) == before
