"""Aggregates, checks, quality and forecasts on hand-made rows."""

import datetime as dt

import pytest
from frames import W1, W2, W3, W4, frame, relays, tables
from pyspark.sql import functions as F

from weekwise.operators import compare, forecast, kpis, master, quality, requests, schedule
from weekwise.params import Params

P = Params()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or ["*"])).collect()), key=lambda r: [str(v) for v in r])


def scored(spark, *items):
    """Rows (relay, store, week, dept, cost, risk)."""
    return spark.createDataFrame(
        [(*i, 10.0, 3.0, 2, "REASON_0", 2024) for i in items],
        "relay_id string, store_id long, wk_end_date date, dept_cat string, total_cost double, risk_score double, "
        "relay_hours double, associate_hours_impact double, historical_moves_count long, request_reason string, relay_year int",
    )


def test_null_group_keys_are_left_out(spark):
    df = scored(spark, ("1", 1, W1, None, 5.0, 1.0), ("2", None, W1, "A", 7.0, 1.0))
    assert [r.dept_cat for r in kpis.dept_summary(df).collect()] == ["A"]
    assert [r.store_id for r in kpis.store_performance(df).collect()] == [1]
    assert rows(kpis.department_breakdown(df), "dept_cat", "share_pct") == [("A", 100.0), ("TOTAL", 100.0)]


def test_empty_input_gives_zero_rows_or_zero_totals(spark):
    none = scored(spark, ("1", 1, W1, "A", 5.0, 1.0)).limit(0)
    asked = frame(spark, "requests")
    assert kpis.exec_summary(none, asked, P).first()[:] == (0, 0.0, 0, 0)
    k = kpis.kpi_metrics(none, P).first()
    assert (k.total_relays, k.total_cost, k.mean_cost, k.payback_weeks) == (0, 0.0, None, None)
    assert kpis.store_performance(none).isEmpty() and kpis.top_risk(none).isEmpty()
    assert kpis.opportunities(none, P).isEmpty()
    placed = none.withColumn("relay_change_perc", F.lit(1.0))
    active = kpis.overactive_groups(placed, frame(spark, "groups"), asked, P)
    assert kpis.overactive_measures(active, P).first()[:] == (0, 0, 0)


def test_overactive_groups_count_distinct_relays_and_chain_rows(spark):
    df = spark.createDataFrame(
        [("A", 2024, str(i % 3), 0.5) for i in range(6)] + [("A", 2024, "9", 0.49), ("B", 2024, "7", 1.0)],
        "dept_cat string, relay_year int, relay_id string, relay_change_perc double",
    )
    asked = frame(spark, "requests", *[{"relay_id": r} for r in ("0", "0", "1", "1", "2", "2", "9")])
    groups = kpis.overactive_groups(df, frame(spark, "groups"), asked, P)
    assert rows(groups, "dept_cat", "distinct_relays", "relay_rows") == [("A", 3, 12), ("B", 1, 1)]
    assert kpis.overactive_measures(groups, P).first()[:] == (1, 3, 1)


def test_overactive_measures_count_departments(spark):
    groups = spark.createDataFrame(
        [("A", 2023, 3, 3), ("A", 2024, 4, 9), ("B", 2024, 2, 2)],
        "dept_cat string, relay_year int, distinct_relays long, relay_rows long",
    )
    assert kpis.overactive_measures(groups, P).first()[:] == (1, 7, 1)


def test_request_months_follow_the_request_time(spark):
    asked = spark.createDataFrame(
        [(dt.datetime(2024, 1, 31, 12), dt.date(2024, 2, 4), "Business")],
        "request_ts timestamp_ntz, original_wk_end_date date, request_type string",
    )
    assert rows(requests.request_seasonality(asked)) == [(1, 1)]
    assert rows(requests.seasonal_patterns(asked)) == [(1, "Business", 1)]


def test_store_months_add_associate_hours(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2024, 1, 7), 10.0, 8.0, 3.0, 1.0), (1, dt.date(2024, 1, 14), 5.0, 8.0, 4.0, 1.0)],
        "store_id long, wk_end_date date, total_cost double, relay_hours double, associate_hours_impact double, risk_score double",
    )
    assert rows(kpis.store_month_cost(df), "store_id", "month", "total_cost", "associate_hours") == [(1, "2024-01", 15.0, 7.0)]


def test_top_risk_breaks_ties_by_key(spark):
    df = scored(spark, *[(str(i), 1, W1, "A", 1.0, 5.0) for i in range(12)])
    assert [r.relay_id for r in kpis.top_risk(df, 3).collect()] == ["0", "1", "10"]


def test_high_risk_is_strictly_above_seven(spark):
    df = scored(spark, ("1", 1, W1, "A", 1.0, 7.0), ("2", 1, W1, "A", 1.0, 7.0001))
    assert kpis.exec_summary(df, frame(spark, "requests"), P).first().high_risk_count == 1


def test_imbalance_uses_the_sample_deviation(spark):
    df = scored(spark, *[(str(i), 1, W1, "A" if i < 9 else "B", 1.0, 1.0) for i in range(10)])
    row = kpis.dept_imbalance(df, P).first()
    assert (row.mean_count, row.std_count, row.is_uneven) == (5.0, 5.6569, True)


def test_month_pivot_fills_zero(spark):
    df = scored(spark, ("1", 1, W1, "A", 5.0, 1.0), ("2", 2, W1 + dt.timedelta(days=35), "A", 7.0, 1.0))
    weeks = df.select("wk_end_date")
    assert rows(compare.store_month_pivot(df, weeks), "store_id", "2024-01", "2024-02") == [(1, 5.0, 0.0), (2, 0.0, 7.0)]


def test_status_share_and_cards(spark):
    asked = frame(
        spark,
        "requests",
        {"request_id": "a", "status": "Pending", "request_type": "Business"},
        {"request_id": "b", "status": "Pending", "request_type": "Merchant"},
        {"request_id": "c", "status": "Approved", "request_type": "Merchant"},
        {"request_id": "d", "status": None},
    )
    assert rows(requests.status_breakdown(asked)) == [("Approved", 1, 33.3333), ("Pending", 2, 66.6667)]
    assert rows(requests.request_status_cards(asked, P)) == [("Approved", 1, 2500), ("Pending", 2, 5000)]


def test_scorecard_rates(spark):
    asked = frame(
        spark,
        "requests",
        {"requested_by": "x", "status": "Approved", "priority_level": "Urgent", "expected_sales_impact": 10.0},
        {"requested_by": "x", "status": "Rejected", "priority_level": "Low", "expected_sales_impact": 20.0},
        {"requested_by": None, "status": "Rejected"},
    )
    assert rows(requests.merchant_scorecard(asked, P)) == [("x", 2, 50.0, 50.0, 30.0, 15.0)]


def load(spark, *items):
    return spark.createDataFrame(items, "wk_end_date date, total_hours double, nm_hours double, nm_rows long")


def test_caps_by_configuration_and_by_load(spark):
    t = tables(spark, [{"relay_id": "1", "wk_end_date": W1}], [], holiday_rows=[{"wk_end_date": W2, "holiday_name": "H"}])
    out = schedule.thresholds_for(t, Params(horizon_weeks=1), schedule.caps_from_params(t.week_bounds, P))
    assert rows(out, "wk_end_date", "total_cap", "nm_cap") == [(W1, 1_000_000.0, 2000.0), (W2, 900_000.0, 1800.0)]
    caps = schedule.caps_from_load(load(spark, (W1, 100.0, 0.0, 0), (W2, 101.0, 10.0, 1))).first()
    assert caps[:] == (105.0, 94.0, 10.0, 9.0)


def test_overage_and_slack_at_below_and_above_cap(spark):
    t = tables(spark, [{"relay_id": "1", "wk_end_date": W1}], [])
    caps = schedule.caps_from_load(load(spark, (W1, 100.0, 10.0, 1)))
    limits = schedule.thresholds_for(t, Params(horizon_weeks=2), caps)
    over = schedule.weekly_overage(load(spark, (W1, 105.0, 5.0, 1), (W2, 110.0, 12.0, 1), (W4, 1.0, 0.0, 0)), limits)
    assert rows(over, "wk_end_date", "total_over", "nm_over", "total_slack") == [
        (W1, 0.0, 0.0, 0.0),
        (W2, 5.0, 2.0, 0.0),
        (W3, 0.0, 0.0, 105.0),
        (W4, 0.0, 0.0, 0.0),
    ]


def assigned(spark, *items):
    """Rows (relay, store, original, suggested)."""
    return spark.createDataFrame(
        [(*i, 2.0, "Large", False, "NO_GROUP") for i in items],
        "relay_id string, store_id long, original_wk_end_date date, suggested_wk_end_date date, relay_hours double, "
        "store_type string, cannot_move boolean, adjustment_group_id string",
    )


def test_two_missing_weeks_do_not_count_as_a_move(spark):
    out = schedule.moved(assigned(spark, ("1", 1, None, None), ("2", 1, W1, None), ("3", 1, W1, W1), ("4", 1, W1, W2)))
    assert [r.relay_id for r in out.orderBy("relay_id").collect()] == ["2", "4"]


def test_assignment_needs_exactly_one_week(spark):
    df = assigned(spark, ("1", 1, W1, W1), ("1", 1, W1, W2), ("2", 1, W1, W1), ("3", 1, W1, None))
    assert rows(schedule.assignment_violations(df), "relay_id", "assigned_weeks") == [("1", 2), ("3", 0)]


def test_requested_assignments_count_weeks_without_the_fan_out(spark):
    asked = frame(
        spark,
        "requests",
        {"relay_id": "1", "requested_move_wk": W2},
        {"relay_id": "1", "requested_move_wk": W3},
        {"relay_id": "1", "requested_move_wk": W3},
        {"relay_id": "2", "requested_move_wk": W2},
    )
    df = assigned(spark, ("1", 1, W1, W1), ("2", 1, W1, W1), ("3", 1, W1, W1))
    assert rows(schedule.requested_assignment_violations(df, asked), "relay_id", "assigned_weeks") == [("1", 2)]


def test_group_split_over_two_weeks_is_reported_in_both(spark):
    groups = frame(spark, "groups", *[{"adjustment_group_id": "G", "relay_id": r} for r in ("1", "2")])
    df = assigned(spark, ("1", 1, W1, W1), ("2", 1, W1, W2), ("1", 1, W3, W3), ("2", 1, W3, W3))
    assert rows(schedule.group_sync_violations(df, groups)) == [("G", W1, 0, 1), ("G", W2, 0, 1)]


def test_move_that_meets_a_pending_request(spark):
    asked = frame(
        spark,
        "requests",
        {"request_id": "a", "relay_id": "1", "store_id": 2, "status": "Pending", "request_type": "Business", "requested_move_wk": W2},
        {"request_id": "b", "relay_id": "1", "store_id": 1, "status": "Approved", "request_type": "Business", "requested_move_wk": W2},
        {"request_id": "c", "relay_id": "2", "store_id": 1, "status": "Pending", "request_type": "Business", "requested_move_wk": W3},
    )
    df = assigned(spark, ("1", 1, W1, W2), ("2", 1, W1, W2), ("3", 1, W1, W2))
    out = schedule.move_request_match(df, asked, P)
    assert rows(out, "relay_id", "req_id", "matches_request") == [
        ("1", "a", True),  # the request names another store of the relay
        ("1", "b", False),
        ("2", "c", False),
        ("3", None, False),
    ]
    assert rows(schedule.request_compliance(df, asked, P)) == [("Business", 2, 1, 50.0)]


def test_years_against_each_other(spark):
    df = relays(
        spark,
        *[{"relay_id": r, "wk_end_date": W1, "dept_cat": d, "relay_year": y} for r, d, y in
          [("1", "A", 2024), ("1", "A", 2024), ("2", "A", 2023), ("3", "B", 2023), ("4", "C", 2024), ("5", "C", 2020)]],
    )
    assert rows(compare.dept_yoy(df)) == [("A", 1, 1, 0), ("B", 0, 1, -1), ("C", 1, 0, 1)]
    assert rows(compare.new_relays(df), "relay_id") == [("1",), ("4",)]


def test_before_after_counts_rows_above_own_percentile(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (8.0, None)], "baseline_cost double, optimized_cost double")
    out = compare.before_after(df, P)
    assert rows(out.filter("scenario = 'Baseline'"), "metric", "value") == [
        ("mean_cost", 3.75),
        ("rows_above_p80", 1.0),
        ("total_cost", 15.0),
    ]


def test_completeness_flags_columns_below_target(spark):
    df = spark.createDataFrame([(1, None)] + [(1, 2)] * 9, "a int, b int")
    assert rows(quality.completeness(df, "t", P)) == [("t", "a", 100.0, False), ("t", "b", 90.0, True)]


def test_volume_uses_the_first_dated_column(spark):
    df = spark.createDataFrame([(1, W1, W4), (2, W1, None)], "a int, start_Date date, end_date date")
    assert rows(quality.dq_volume({"t": df, "u": df.select("a")})) == [("t", "start_Date", "2024-01", 2)]


def test_histogram_closes_the_top_edge_and_keeps_constants(spark):
    df = spark.createDataFrame([(float(i), 7, "x") for i in range(21)], "a double, b int, c string")
    out = quality.dq_histogram(df)
    assert rows(out.filter("column_name = 'b'")) == [("b", 0, 21)]
    assert dict(rows(out.filter("column_name = 'a'"), "bin", "row_count"))[19] == 2


def test_orphans(spark):
    child = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "k string")
    parent = spark.createDataFrame([("2",), ("3",)], "k string")
    assert rows(quality.orphan_rate(child, parent, ["k"], "fk")) == [("fk", 2, 3, 66.6667)]


def test_rule_with_unknown_value_fails(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert rows(quality.rule_rates(df, "t", {"positive": F.col("a") > 0})) == [("t", "positive", 1, 50.0)]


def weekly(spark, *costs):
    return spark.createDataFrame(
        [(W1 + dt.timedelta(days=7 * i), float(c), float(c)) for i, c in enumerate(costs)],
        "wk_end_date date, total_cost double, relay_hours double",
    )


def test_forecast_follows_a_line(spark):
    w = weekly(spark, *[1000 + 100 * i for i in range(10)])
    bounds = w.agg(F.min("wk_end_date").alias("first_week"), F.max("wk_end_date").alias("last_week"))
    out = forecast.weekly_forecast(w, bounds, P).orderBy("wk_end_date").collect()
    assert len(out) == 12 and out[0].forecast_cost == 2000.0 and out[-1].forecast_cost == 3100.0
    assert (out[0].forecast_hours, out[0].forecast_count, out[0].risk_level) == (80.0, 2, "Low")


def test_peak_weeks_are_above_mean_and_deviation(spark):
    assert rows(forecast.peak_weeks(weekly(spark, 1, 1, 1, 1, 9)), "relay_hours") == [(9.0,)]


def test_trend_signs(spark):
    out = forecast.kpi_trend(weekly(spark, *([10] * 4 + [20] * 4 + [20] * 5)))
    assert [(r.month, r.trend_pct, r.direction) for r in out.orderBy("month").collect()] == [
        ("2024-01", 0.0, "flat"),
        ("2024-02", 100.0, "up"),
        ("2024-03", 25.0, "up"),
    ]


@pytest.fixture(scope="module")
def benefit(spark):
    base = spark.createDataFrame([(200_000.0,)], "objective double")
    best = spark.createDataFrame([(100_000.0,)], "objective double")
    weeks = spark.range(100).select(F.col("id").alias("wk_end_date"))
    return forecast.cost_benefit(base, best, weeks, P)


def test_benefit_waterfall_and_timeline(spark, benefit):
    row = benefit.first()
    assert (row.savings, row.weekly_savings, row.annual_savings, row.payback_weeks, row.roi_pct) == (
        100_000.0,
        1000.0,
        52_000.0,
        50.0,
        104.0,
    )
    steps = [r.amount for r in forecast.cost_waterfall(benefit).orderBy("position").collect()]
    assert sum(steps[:4]) == pytest.approx(steps[4])
    line = {r.week_number: r.net_benefit for r in forecast.roi_timeline(benefit, P).collect()}
    assert len(line) == 52 and line[50] == 0.0


def test_what_if_scales_the_cap(spark):
    over = spark.createDataFrame([(100.0, 100.0), (120.0, 100.0)], "total_hours double, total_cap double")
    out = rows(forecast.what_if_thresholds(over, {"tight": 0.9, "now": 1.0}, P))
    assert out == [("now", 1, 20.0, 200.0), ("tight", 2, 40.0, 400.0)]


def test_quadrants_cover_all_relays(spark):
    df = scored(spark, *[(str(i), 1, W1, "A", 10.0 * (i + 1), 1.0) for i in range(4)])
    asked = frame(spark, "requests", {"relay_id": "0", "expected_sales_impact": 50.0}, {"relay_id": "3", "expected_sales_impact": 1.0})
    out = forecast.cost_roi_quadrants(forecast.cost_roi(df, asked), P)
    assert rows(out, "quadrant", "relay_count") == [("Low value", 1), ("Quick win", 1), ("Reconsider", 2)]


def test_document_is_json(spark):
    import json

    df = scored(spark, ("1", 1, W1, "A", 5.0, 8.0), ("2", 2, W1, "B", 7.5, 1.0))
    asked = frame(spark, "requests", {"status": "Pending"}, {"status": "Approved"})
    benefit = spark.createDataFrame(
        [(10.0, 8.0, 2.0, 1.0, 52.0, 0.1, None)],
        "baseline_cost double, optimized_cost double, savings double, weekly_savings double, annual_savings double, "
        "roi_pct double, payback_weeks double",
    )
    made = kpis.dashboard_document(df, asked, benefit, forecast.weekly_cost(df), F.lit(W1), P)
    doc = json.loads(made.first().document)
    assert doc["data_timestamp"] == str(W1)
    assert doc["executive_summary"] == {"total_relays": 2, "total_cost": "12.50", "high_risk_count": 1, "pending_requests": 1}
    assert doc["cost_benefit"]["annual_savings"] == doc["kpi_metrics"]["annual_savings"] == "52.00"
    assert doc["kpi_metrics"]["payback_weeks"] is None and doc["trends"][0]["total_cost"] == "12.50"
    assert [d["dept_cat"] for d in doc["department_summary"]] == ["A", "B"]
    assert [r["relay_id"] for r in doc["top_risk_relays"]] == ["1", "2"]


def test_requested_schedule_moves_pending_only(spark):
    t = tables(
        spark,
        [{"relay_id": "1", "wk_end_date": W1, "short_desc": "Seasonal"}, {"relay_id": "2", "wk_end_date": W1}],
        [{"relay_id": r, "wk_end_date": W1, "store_id": 1} for r in ("1", "2")],
        request_rows=[
            {"relay_id": "1", "requested_move_wk": W2},
            {"relay_id": "2", "requested_move_wk": W2, "status": "Approved"},
        ],
    )
    out = schedule.requested_schedule(master.instances(t, P), P)
    assert rows(out, "relay_id", "suggested_wk_end_date") == [("1", W2), ("2", W1)]
    assert schedule.cannot_move_violations(out).count() == 1
