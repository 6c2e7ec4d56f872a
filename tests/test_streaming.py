"""Streams equal batches over the same rows; rows beyond the watermark are dropped."""

import datetime as dt
import os

from pyspark.sql import functions as F

from weekwise.sources.adapters import RAW
from weekwise.streaming import live

T0 = dt.datetime(2024, 1, 1)
BATCH = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def drop(spark, folder, i, *events):
    """The i-th file of the stream's folder: (id, minute, user)."""
    data = [(e, T0 + dt.timedelta(minutes=m), u, "click", float(e)) for e, m, u in events]
    known = set(os.listdir(folder)) if folder.exists() else set()
    spark.createDataFrame(data, BATCH).coalesce(1).write.mode("append").parquet(str(folder))
    for name in set(os.listdir(folder)) - known:
        # the file source takes files in order of modification
        os.utime(folder / name, (10**9 + i, 10**9 + i))


def stream(spark, folder):
    return (
        spark.readStream.schema(RAW["events"])
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(folder))
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def test_counts_over_several_batches_drop_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    drop(spark, src, 1, (1, 1, 1), (2, 2, 1))
    drop(spark, src, 2, (3, 3, 1), (4, 60, 1))
    drop(spark, src, 3, (5, 61, 1))
    drop(spark, src, 4, (6, 4, 1), (7, 62, 1))
    out = live.run_updates(live.tumbling_counts(stream(spark, src)), ["window_start", "event_type"])
    got = {r.window_start.strftime("%H:%M"): r.event_count for r in out.collect()}
    assert got == {"00:00": 3, "01:00": 3}  # event 6 came more than ten minutes late


def test_latest_state_per_key_over_several_batches(spark, tmp_path):
    src = tmp_path / "in"
    drop(spark, src, 1, (1, 5, 1), (2, 1, 2))
    drop(spark, src, 2, (3, 4, 1), (4, 9, 2))
    drop(spark, src, 3, (5, 5, 1))
    out = live.run_updates(live.latest_by_key(stream(spark, src), "user_id"), ["user_id"])
    assert {r.user_id: r.event_id for r in out.collect()} == {1: 5, 2: 4}
