"""Sums in decimal and objectives from week pairs."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from weekwise.functions.columns import decimal_sum, exact_sum
from weekwise.operators import schedule
from weekwise.params import Params

P = Params()


def test_decimal_sum_equals_the_sum_of_decimals(spark):
    r = random.Random(5)
    values = [0.0, -0.0, 0.1, 2.5, 0.005, 1.005, 2.675, -1.115, 9_999_999.99, 1e7, 1e7 + 0.01, 123456789.125, -3e12, 1e-9, 0.1 + 0.2, None]
    values += [round(r.uniform(-1e5, 1e5), r.choice((0, 1, 2, 3, 7))) for _ in range(3000)]
    rows = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "g int, v double")
    found = rows.groupBy("g").agg(
        decimal_sum("v").alias("new"), F.sum(F.col("v").cast("decimal(18,2)")).alias("old"), exact_sum("v").alias("e")
    ).collect()
    cents = Decimal("0.01")
    for row in found:
        own = [v for i, v in enumerate(values) if i % 7 == row.g and v is not None]
        assert row.new == row.old == sum(Decimal(repr(v)).quantize(cents, ROUND_HALF_UP) for v in own)
        assert row.e == float(row.old)


def test_decimal_sum_over_nothing_is_null(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert tuple(empty.agg(decimal_sum("v").alias("d"), exact_sum("v").alias("e")).first()) == (None, 0.0)


def test_objective_from_week_pairs(spark):
    """Moves count rows, a missing week is no load, and two missing weeks are no move."""
    a, b = dt.date(2024, 1, 7), dt.date(2024, 1, 14)
    rows = spark.createDataFrame(
        [("1", 1, a, b, 7.25, "Neighborhood"), ("2", 1, a, b, 7.255, "Large"), ("3", 1, a, a, 4.0, None),
         ("4", 1, None, None, 5.0, "Large"), ("5", 1, a, None, 3.0, "Large"), ("6", 1, b, b, None, "Neighborhood")],
        "relay_id string, store_id bigint, original_wk_end_date date, suggested_wk_end_date date, relay_hours double, store_type string",
    )
    caps = spark.createDataFrame([(a, False, 1.0, 0.0), (b, False, 10.0, 5.0)], "wk_end_date date, is_holiday boolean, total_cap double, nm_cap double")
    pairs = schedule.week_pairs(rows, P)
    kept = schedule.pairs_objective(schedule.fallback_pairs(pairs), caps, P, "x").first()
    assert tuple(kept) == ("x", 0, 20.51, 7.25, 277.6)
    assert schedule.schedule_objective(schedule.fallback_schedule(rows), caps, P, "x").first() == kept
    assert tuple(schedule.schedule_objective(rows, caps, P, "y").first()) == ("y", 3, 7.51, 2.25, 97.9)
