"""Keyed store, request stream, resumable stages, hot keys, listings and text."""

import datetime as dt
from functools import reduce

import pytest
from frames import W1, W2, frame
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.functions.skew import hot_keys, split_left_join
from weekwise.sources import io
from weekwise.sources.stages import Stages, file_fingerprint
from weekwise.streaming import live
from weekwise.streaming.store import KeyedStore


def batch(spark, *rows):
    return spark.createDataFrame(rows, "k long, v string")


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*.parquet"))


def test_store_reads_one_row_per_key_and_does_not_grow(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), batch(spark).schema, ["k"], buckets=4, order=("v",))
    assert store.read().count() == 0
    sizes = []
    for i in range(6):
        store.upsert(batch(spark, (1, f"a{i}"), (1, f"b{i}"), (i % 2 + 10, f"c{i}")), i)
        sizes.append(len(files(tmp_path / "s" / "rows")))
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "a5"), (10, "c4"), (11, "c5")]
    assert max(sizes[2:]) <= sizes[2] + 3  # old versions are deleted
    assert len(store.read().inputFiles()) <= 4


def test_store_repeats_a_batch_from_the_same_state(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), batch(spark).schema, ["k"], buckets=2)
    store.upsert(batch(spark, (1, "old"), (2, "old")), 0)
    store.upsert(batch(spark, (1, "half")), 1)
    again = KeyedStore(spark, str(tmp_path / "s"), batch(spark).schema, ["k"], buckets=2)
    again.upsert(batch(spark, (2, "new")), 1)  # the restarted query repeats batch 1
    assert sorted(tuple(r) for r in again.read().collect()) == [(1, "old"), (2, "new")]
    again.upsert(batch(spark), 2)
    assert again.read().count() == 2


REQUEST = dict(store_id=1, request_type="Business", status="Pending", requested_move_wk=W1)


def request(i, day, relay="a"):
    return dict(REQUEST, request_id=f"REQ_{i}", relay_id=relay, request_ts=dt.datetime(2024, 1, 1) + dt.timedelta(days=day))


def test_requests_come_twice_and_late(spark):
    rows = [
        (0, request(1, 0)), (0, request(1, 0)), (0, request(2, 50, "b")),
        (1, request(1, 0)), (1, request(3, 100)),  # the watermark is at day 40: request 1 is late now
        (2, request(4, 39)), (2, request(3, 100)), (2, request(5, 95, None)),  # and at day 90 now
    ]
    feed = reduce(DataFrame.unionByName, [frame(spark, "requests", r).withColumn("delivery", F.lit(n)) for n, r in rows])
    bridge = frame(spark, "bridge", dict(relay_id="a", wk_end_date=W1, store_id=1), dict(relay_id="a", wk_end_date=W2, store_id=2))
    taken, counts = live.run_deliveries(feed, bridge, "delivery", "10 days")
    got = {r.request_id: (r.n_stores, r.in_own_week) for r in taken.collect()}
    assert got == {"REQ_1": (2, True), "REQ_2": (0, False), "REQ_3": (2, True), "REQ_5": (0, False)}
    assert [tuple(r) for r in counts.orderBy("delivery").collect()] == [(0, 3, 0, 1, 2), (1, 2, 1, 0, 1), (2, 3, 1, 1, 1)]


# -- stages ----------------------------------------------------------------------


def test_a_killed_run_resumes_and_a_changed_input_recomputes(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)
    built = []

    def run(factor, fail=False):
        stages = Stages(spark, str(tmp_path / "out"))

        def rows():
            return spark.read.parquet(src)

        def scaled():
            built.append(factor)
            if fail:
                raise RuntimeError("killed")
            return a.select((F.col("id") * factor).alias("id"))

        a = stages.run("rows", rows, files=file_fingerprint(spark, src))
        stages.run("scaled", scaled, after=("rows",), factor=factor)
        return stages.outcome

    with pytest.raises(RuntimeError):
        run(2, fail=True)
    assert run(2) == {"rows": (5, True), "scaled": (5, False)}
    assert run(2) == {"rows": (5, True), "scaled": (5, True)}
    assert run(3) == {"rows": (5, True), "scaled": (5, False)}
    spark.range(7).write.mode("overwrite").parquet(src)
    assert run(3) == {"rows": (7, False), "scaled": (7, False)}


def test_a_reused_stage_is_not_built(spark, tmp_path):
    built = []

    def work():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        stages = Stages(spark, str(tmp_path))
        got = stages.run("work", work, like=spark.range(0), n=3)
    assert built == [1] and got.count() == 3 and stages.outcome == {"work": (3, True)}
    with pytest.raises(ValueError, match="built"):
        Stages(spark, str(tmp_path)).run("work", work, like=spark.range(0).selectExpr("id AS other"), n=4)


def test_an_empty_stage_stops_the_run(spark, tmp_path):
    with pytest.raises(io.EmptyInput):
        Stages(spark, str(tmp_path)).run("none", lambda: spark.range(0))


# -- hot keys --------------------------------------------------------------------


def test_hot_key_is_dealt_to_several_tasks(spark):
    """A third of the right rows have one key; no task gets more than three times the median."""
    right = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"),
        F.col("id").alias("r"),
    )
    left = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("lost", 4), (None, 5)], "key string, l int")
    hot = hot_keys(right, "key", parts=24)
    assert set(hot) == {"hot"} and hot["hot"] == 32
    got = split_left_join(left, right.withColumn("salt", F.col("r")), "key", ["salt"], hot)
    plain = left.join(right, "key", "left")
    assert got.columns == plain.columns
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    piece = F.when(F.col("key") == "hot", F.pmod(F.xxhash64("r"), F.lit(32))).otherwise(0)
    sizes = sorted(r[0] for r in right.repartition(24, "key", piece).groupBy(F.spark_partition_id()).count().select("count").collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_hot_key_with_an_empty_piece(spark):
    right = spark.createDataFrame([("h", 1)] * 6, "key string, r int")
    left = spark.createDataFrame([("h", 1), ("x", 2)], "key string, l int")
    got = split_left_join(left, right.withColumn("salt", F.lit(1)), "key", ["salt"], {"h": 5})
    assert sorted(map(tuple, got.collect()), key=str) == [("h", 1, 1)] * 6 + [("x", 2, None)]


# -- listings and text --------------------------------------------------------------


def test_sorted_listing_has_positions(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(5)
    path = io.export_sorted(rows, str(tmp_path / "l"), "a", "id")
    got = [(r.a, r.id) for r in io.load_sorted(spark, path).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 500
    assert io.load_sorted(spark, path).agg(F.min("position"), F.max("position")).first()[:] == (1, 500)


def test_text_import_cleans_keys_and_dates(spark, tmp_path):
    text = "request_id,relay_id,store_id,request_type,status,requested_move_wk,original_wk_end_date,requested_by,priority_level,expected_sales_impact,cost_estimate,request_ts\n"
    text += "R1,  7 ,3,Business,Pending,2024-01-07 08:30:00,soon,me,High,1.5,x,2024-01-01 00:00:00\n"
    (tmp_path / "r.csv").write_text(text)
    r = io.load_text(spark, str(tmp_path / "r.csv"), "requests").first()
    assert (r.relay_id, r.store_id, r.requested_move_wk, r.original_wk_end_date) == ("7", 3, W1, None)
    assert (r.expected_sales_impact, r.cost_estimate) == (1.5, None)
