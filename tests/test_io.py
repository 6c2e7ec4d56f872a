"""Sources, sinks, guards and settings."""

import os

import pytest
from frames import W1, frame, relays
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weekwise import session
from weekwise.sources import io
from weekwise.sources.schemas import LOGICAL, conform


def test_missing_column_raises(spark):
    with pytest.raises(ValueError, match="store_type"):
        conform(spark.createDataFrame([(1, "x")], "store_id long, region string"), "stores")


def test_stored_tables_load_with_clean_keys(spark, tmp_path):
    for name in LOGICAL:
        rows = [{"relay_id": " 7 ", "wk_end_date": W1}] if name in ("relays", "bridge") else []
        df = relays(spark, *rows) if name == "relays" else frame(spark, name, *rows)
        io.save_table(df, str(tmp_path / name))
    t = io.load_stored(spark, str(tmp_path))
    assert t.relays.first().relay_id == "7" and t.week_bounds.first()[:] == (W1, W1)
    assert t.relays.join(t.bridge, ["relay_id", "wk_end_date"]).count() == 1
    assert {r.table_name: r.row_count for r in io.row_counts(t).collect()}["relays"] == 1


def test_missing_table_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        io.load_stored(spark, str(tmp_path / "nowhere")).relays.count()


def test_reload_falls_back_when_missing_or_empty(spark, tmp_path):
    spare = spark.range(3)
    assert io.load_table(spark, str(tmp_path / "none"), lambda: spare).count() == 3
    with pytest.raises(AnalysisException):
        io.load_table(spark, str(tmp_path / "none"))
    path = io.save_table(spark.range(0), str(tmp_path / "empty"))
    assert io.load_table(spark, path, lambda: spare).count() == 3
    path = io.save_table(spark.range(5), str(tmp_path / "full"))
    assert io.load_table(spark, path, lambda: spare).count() == 5


def test_guard_stops_on_empty_input(spark):
    assert io.require_rows(spark.range(1), "stage").count() == 1
    with pytest.raises(io.EmptyInput, match="stage"):
        io.require_rows(spark.range(0), "stage")


def test_sql_errors_raise(spark):
    assert io.sql_source(spark, "SELECT sum(id) AS s FROM {t}", t=spark.range(4)).first().s == 6
    with pytest.raises(AnalysisException):
        io.sql_source(spark, "SELECT nothing FROM {t}", t=spark.range(4))


def test_csv_has_a_header_and_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, True)], "s string, x double, b boolean")
    assert io.csv_export(df).collect() == df.collect()
    path = io.export_csv(df, str(tmp_path / "csv"))
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    assert open(os.path.join(path, part)).readline().strip() == "s,x,b"


def test_document_is_written_as_text(spark, tmp_path):
    path = io.export_text(spark.createDataFrame([('{"a":1}',)], "document string"), str(tmp_path / "doc"))
    assert spark.read.text(path).first()[0] == '{"a":1}'


def test_stored_tables_go_to_the_named_folder(spark):
    base = session.shared_dir(spark)
    assert base == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x").startswith(base)
    df = session.materialize(spark.range(10).withColumn("y", F.lit("a")), "test")
    assert df.count() == 10 and f"{base}/weekwise/test-" in df.inputFiles()[0]
