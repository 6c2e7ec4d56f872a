"""Flags, joins, instances and keys on hand-made rows."""

import hashlib

import pytest
from frames import W1, W2, W3, frame, relays, tables
from pyspark.sql import functions as F

from weekwise.functions.columns import (
    column_or,
    half_up,
    instance_key,
    lenient_date,
    money_label,
    project_existing,
    week_end,
)
from weekwise.operators import calendar, master
from weekwise.params import Params
from weekwise.session import materialize
from weekwise.sources import adapters

P = Params()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: [str(v) for v in r])


def test_week_end_is_sunday_on_or_after(spark):
    df = spark.createDataFrame([("2024-01-07",), ("2024-01-08",), ("2024-01-13",), (None,)], "d string")
    got = [r[0] and str(r[0]) for r in df.select(week_end(F.col("d"))).collect()]
    assert got == ["2024-01-07", "2024-01-14", "2024-01-14", None]


def test_lenient_date_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("2024-01-07",), ("not a date",)], "d string")
    assert [str(r[0]) for r in df.select(lenient_date(F.col("d"))).collect()] == ["2024-01-07", "None"]


def test_instance_key_has_na_for_missing_date(spark):
    df = spark.createDataFrame([("7", 3, W1), ("7", 3, None)], "relay_id string, store_id long, original_wk_end_date date")
    assert [r[0] for r in df.select(instance_key()).collect()] == ["7_3_2024-01-07", "7_3_NA"]


def test_projection_raises_on_missing_required_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert project_existing(df, ["a"], ["b", "c"]).columns == ["a", "b"]
    with pytest.raises(ValueError):
        project_existing(df, ["c"])


def test_column_or_uses_constant_where_column_is_missing(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert df.select(column_or(df, "a", 9.0), column_or(df, "b", 9.0)).first()[:] == (1.0, 9.0)


def test_money_labels(spark):
    df = spark.createDataFrame([(2_500_000.0,), (1_234.0,), (999.4,), (1_250_000.0,)], "x double")
    assert [r[0] for r in df.select(money_label(F.col("x"))).collect()] == ["$2.5M", "$1.2K", "$999", "$1.3M"]


def test_half_up(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(half_up(F.col("x"), 0)).collect()] == [3.0, 4.0, -2.0, None]


def test_flags_and_missing_year(spark):
    df = relays(
        spark,
        {"relay_id": "1", "wk_end_date": W1, "short_desc": "Seasonal", "relay_year": None},
        {"relay_id": "2", "wk_end_date": W1, "short_desc": "Realignment"},
        {"relay_id": "3", "wk_end_date": W1, "short_desc": None},
    )
    got = rows(master.relay_flags(df, P), "relay_id", "is_seasonal", "is_dc_realign", "cannot_move", "relay_year")
    assert got == [("1", True, False, True, 2024), ("2", False, True, True, 2024), ("3", False, False, False, 2024)]
    with pytest.raises(ValueError):
        master.with_hours(df, "no_such_column")


def test_null_join_keys_never_match(spark):
    t = tables(
        spark,
        [{"relay_id": None, "wk_end_date": W1}, {"relay_id": "1", "wk_end_date": W1}],
        [{"relay_id": None, "wk_end_date": W1, "store_id": 1}, {"relay_id": "1", "wk_end_date": W1, "store_id": 1}],
    )
    assert master.relay_store_join(t.relays, t.bridge, P).count() == 1


def test_duplicate_holiday_weeks_do_not_fan_out(spark):
    t = tables(
        spark,
        [{"relay_id": "1", "wk_end_date": W1}, {"relay_id": "1", "wk_end_date": W2}],
        [{"relay_id": "1", "wk_end_date": w, "store_id": 1} for w in (W1, W2)],
        holiday_rows=[
            {"wk_end_date": W1, "holiday_name": "B"},
            {"wk_end_date": W1, "holiday_name": "C", "holiday_type": "Major"},
        ],
    )
    placed = master.relay_store_join(t.relays, t.bridge, P)
    got = rows(master.holiday_flags(placed, t.holidays), "wk_end_date", "is_holiday", "holiday_name")
    assert got == [(W1, True, "C"), (W2, False, "None")]


def chain(spark):
    return tables(
        spark,
        [{"relay_id": "1", "wk_end_date": W1}, {"relay_id": "2", "wk_end_date": W1}, {"relay_id": "3", "wk_end_date": W2}],
        [
            {"relay_id": "1", "wk_end_date": W1, "store_id": 1},
            {"relay_id": "1", "wk_end_date": W1, "store_id": 2, "store_type": None},
            {"relay_id": "2", "wk_end_date": W1, "store_id": 1},
            {"relay_id": "3", "wk_end_date": W2, "store_id": 9},
        ],
        request_rows=[
            {"request_id": "a", "relay_id": "1", "requested_move_wk": None, "status": "Approved"},
            {"request_id": "b", "relay_id": "1", "requested_move_wk": W2},
            {"request_id": "c", "relay_id": "1", "requested_move_wk": W3, "request_type": "Merchant"},
            {"request_id": "d", "relay_id": "2", "requested_move_wk": W1},
        ],
        group_rows=[
            {"adjustment_group_id": "G2", "relay_id": "1"},
            {"adjustment_group_id": "G1", "relay_id": "1"},
        ],
    )


def test_chain_fans_out_by_groups_and_requests(spark):
    t = chain(spark)
    full = master.master_schedule(t, P)
    assert full.count() == 2 * 2 * 3 + 1 + 1
    alone = full.filter("relay_id = '3'").first()
    assert (alone.adjustment_group_id, alone.status, alone.request_type, alone.requested_move_wk) == (
        "NO_GROUP",
        "None",
        "None",
        None,
    )
    assert full.filter("store_id = 2").first().store_type == "Unknown"


def test_counted_fan_out_equals_the_real_one(spark):
    t = chain(spark)
    placed = master.relay_store_join(t.relays, t.bridge, P)
    counted = master.fan_out(placed, t.groups, t.requests)
    assert rows(counted.groupBy("relay_id", "store_id").agg(F.sum("copies")), "*") == rows(
        master.master_schedule(t, P).groupBy("relay_id", "store_id").count(), "*"
    )


KEPT = ["relay_id", "store_id", "original_wk_end_date", "adjustment_group_id", "request_type", "requested_move_wk", "status"]


def test_best_row_takes_latest_request_and_puts_missing_last(spark):
    best = master.dedupe_instances(master.master_schedule(chain(spark), P))
    assert best.count() == 4
    row = best.filter("relay_id = '1' AND store_id = 1").first()
    assert (row.requested_move_wk, row.request_type, row.adjustment_group_id) == (W3, "Merchant", "G1")


def test_instances_equal_deduplicated_chain(spark, sf_dir):
    for t in (chain(spark), adapters.load_tables(spark, sf_dir)):
        whole = master.dedupe_instances(master.master_schedule(t, P)).select(*KEPT)
        for unique in (False, True):
            short = master.instances(t, P, unique_keys=unique).select(*KEPT)
            assert whole.exceptAll(short).isEmpty() and short.exceptAll(whole).isEmpty()


def test_instances_of_stored_rows_are_the_same(spark):
    t = chain(spark)
    placed = materialize(master.relay_store_join(t.relays, t.bridge, P), "placed")
    whole = master.instances(t, P, unique_keys=True).select(*KEPT)
    short = master.instances(t, P, unique_keys=True, placed=placed).select(*KEPT)
    assert whole.exceptAll(short).isEmpty() and short.exceptAll(whole).isEmpty()


def test_repeated_relay_rows_leave_one_instance(spark):
    t = tables(
        spark,
        [
            {"relay_id": "1", "wk_end_date": W1, "relay_change_perc": 0.2, "total_store_hours": 5.0},
            {"relay_id": "1", "wk_end_date": W1, "relay_change_perc": 0.9, "total_store_hours": 7.0},
        ],
        [{"relay_id": "1", "wk_end_date": W1, "store_id": 1}],
    )
    assert [r.relay_hours for r in master.instances(t, P).collect()] == [7.0]


def test_key_suffix_numbers_all_copies_of_a_hot_key(spark):
    copies = 500
    data = [("hot", "G1")] * copies + [("hot", f"G{i}") for i in range(2, 60)] + [("cold", "NO_GROUP")]
    df = spark.createDataFrame(data, "instance_key string, adjustment_group_id string")
    out = master.key_suffix(df, Params(copy_chunk=64, prefix_hex_digits=1)).cache()
    assert out.count() == len(data)
    assert out.select("unique_key").distinct().count() == len(data)
    hot = sorted(r.counter for r in out.filter("instance_key = 'hot'").collect())
    assert hot == list(range(copies + 58))
    assert out.filter("instance_key = 'cold'").first().unique_key == "cold"
    assert out.filter("adjustment_group_id = 'G1'").count() == copies


@pytest.mark.parametrize("hot", [[], ["a"], ["a", "b", "c"]])
def test_key_suffix_numbers_alike_together_and_in_buckets(spark, monkeypatch, hot):
    data = [(k, g) for k in "abc" for g in ["G1", "G1", "G2", None, *(f"X{i}" for i in range(20))]] + [("d", "G1"), (None, "G1")]
    monkeypatch.setattr(master, "hot_keys", lambda *args, **kwargs: dict.fromkeys(hot, 1))
    df = spark.createDataFrame(data, "instance_key string, adjustment_group_id string")
    wanted = []
    for key in "abcd":
        text = {g: f"{key}|{g or ''}" for k, g in data if k == key}
        mine = sorted((g for k, g in data if k == key), key=lambda g: (hashlib.md5(text[g].encode()).hexdigest(), text[g]))
        wanted += [(key, g, i, f"{key}_{i}" if i else key) for i, g in enumerate(mine)]
    found = master.key_suffix(df, Params(copy_chunk=1, prefix_hex_digits=1)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "instance_key string")
    assert rows(master.duplicate_keys(df), "*") == [("a", 2)]


def test_scope_starts_at_the_lookback(spark):
    import datetime as dt

    t = tables(
        spark,
        [{"relay_id": "1", "wk_end_date": W1}],
        [{"relay_id": "1", "wk_end_date": W1, "store_id": 1}],
    )
    placed = master.relay_store_join(t.relays, t.bridge, P)
    exact = Params(as_of=W1 + dt.timedelta(days=365))
    late = Params(as_of=W1 + dt.timedelta(days=366))
    assert master.optim_scope(placed, t.week_bounds, exact).count() == 1
    assert master.optim_scope(placed, t.week_bounds, late).count() == 0


def test_calendar_covers_data_and_horizon(spark):
    t = tables(spark, [{"relay_id": "1", "wk_end_date": W1}, {"relay_id": "1", "wk_end_date": W3}], [])
    weeks = [r[0] for r in calendar.week_calendar(t.week_bounds, Params(horizon_weeks=2)).orderBy("wk_end_date").collect()]
    assert len(weeks) == 5 and weeks[0] == W1 and all(w.isoweekday() == 7 for w in weeks)
    short = calendar.week_calendar(t.week_bounds, Params(horizon_weeks=0, lookback_days=7), lookback=True)
    assert [r[0] for r in short.orderBy("wk_end_date").collect()] == [W2, W3]


def test_holidays_fall_on_their_weeks(spark):
    t = tables(spark, [{"relay_id": "1", "wk_end_date": W1}], [])
    days = {(r.holiday_name, str(r.wk_end_date)) for r in calendar.holiday_calendar(t.week_bounds).collect()}
    assert ("Thanksgiving", "2024-12-01") in days  # 28 November 2024 is a Thursday
    assert ("Christmas", "2024-12-29") in days and ("New Year", "2023-12-31") in days
    assert len(days) == 12


def test_cost_and_risk_formulas(spark):
    df = relays(
        spark,
        {"relay_id": "1", "wk_end_date": W1, "associate_hours_impact": 8.0, "total_store_hours": 20.0},
        {"relay_id": "2", "wk_end_date": W1, "associate_hours_impact": 16.0, "total_store_hours": 40.0, "market_factor": 4.0},
    )
    got = rows(master.scored_relays(df, P), "relay_id", "labour_cost", "setup_cost", "total_cost", "risk_score", "risk_category")
    first = round(8 * 3 / 16 + 1 + 3 * 720 / 1340, 4)
    assert got == [("1", 120.0, 500.0, 720.0, first, "Medium"), ("2", 240.0, 1000.0, 1340.0, 10.0, "High")]


def test_cost_defaults_where_columns_are_missing(spark):
    df = spark.createDataFrame([("1",)], "relay_id string")
    row = master.move_cost(df, P).first()
    assert (row.labour_cost, row.setup_cost, row.total_cost) == (120.0, 500.0, 620.0)


def test_empty_frame_helper(spark):
    assert frame(spark, "groups").isEmpty()
