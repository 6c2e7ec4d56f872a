"""Week and holiday calendars.

Both start from a one-row frame of dates, so their row count is bounded by
the span of the data: about 52 weeks and 12 holiday rows per year. Spark
knows that a global aggregate is one row and broadcasts them by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import week_end
from weekwise.params import Params


def as_of_date(bounds: DataFrame, params: Params) -> Column:
    """The explicit `as_of` or, without one, the last work week as a scalar subquery."""
    if params.as_of is not None:
        return F.lit(params.as_of)
    return bounds.select("last_week").scalar()


def first_open_week(bounds: DataFrame, params: Params) -> Column:
    """First week within the lookback of `as_of`: older weeks are closed to changes."""
    return week_end(F.date_sub(as_of_date(bounds, params), params.lookback_days))


def report_bounds(bounds: DataFrame, suggested: DataFrame) -> DataFrame:
    """First and last week of the work table and of a suggested schedule together."""
    planned = suggested.agg(F.min("suggested_wk_end_date").alias("lo"), F.max("suggested_wk_end_date").alias("hi"))
    lo, hi = (planned.select(c).scalar() for c in ("lo", "hi"))
    return bounds.select(
        F.least("first_week", lo).alias("first_week"), F.greatest("last_week", hi).alias("last_week")
    )


def week_calendar(bounds: DataFrame, params: Params, lookback: bool = False) -> DataFrame:
    """Sundays from the first work week to `as_of` plus the horizon.

    With `lookback` the calendar starts no earlier than `as_of` less the
    lookback days.
    """
    as_of = F.lit(params.as_of) if params.as_of is not None else F.col("last_week")
    first = F.col("first_week")
    if lookback:
        first = F.greatest(first, week_end(F.date_sub(as_of, params.lookback_days)))
    last = F.date_add(week_end(as_of), 7 * params.horizon_weeks)
    return bounds.select(
        F.explode(F.sequence(first, last, F.expr("INTERVAL 7 DAYS"))).alias("wk_end_date")
    )


def holiday_calendar(bounds: DataFrame) -> DataFrame:
    """Weeks around the yearly holidays: the holiday's own week, the one before and the one after."""
    years = bounds.select(F.explode(F.sequence(F.year("first_week"), F.year("last_week"))).alias("y"))
    # fixed values: the holidays and their class
    named = years.select(
        F.explode(
            F.array(
                F.struct(F.make_date("y", F.lit(1), F.lit(1)).alias("day"), F.lit("New Year").alias("name"), F.lit("Standard").alias("kind")),
                F.struct(F.make_date("y", F.lit(7), F.lit(4)).alias("day"), F.lit("Independence Day").alias("name"), F.lit("Standard").alias("kind")),
                F.struct(
                    F.date_add(F.next_day(F.make_date("y", F.lit(10), F.lit(31)), "THU"), 21).alias("day"),
                    F.lit("Thanksgiving").alias("name"),
                    F.lit("Major").alias("kind"),
                ),
                F.struct(F.make_date("y", F.lit(12), F.lit(25)).alias("day"), F.lit("Christmas").alias("name"), F.lit("Major").alias("kind")),
            )
        ).alias("h")
    )
    return named.select(
        F.explode(F.array(F.lit(-7), F.lit(0), F.lit(7))).alias("shift"), "h"
    ).select(
        week_end(F.date_add("h.day", F.col("shift"))).alias("wk_end_date"),
        F.col("h.name").alias("holiday_name"),
        F.col("h.kind").alias("holiday_type"),
        F.lit(True).alias("is_holiday"),
    )


def holiday_weeks(holidays: DataFrame) -> DataFrame:
    """One row per week, so a join on the week never fans out; a Major holiday names the week."""
    pick = Window.partitionBy("wk_end_date").orderBy("holiday_type", "holiday_name")
    return (
        holidays.filter(F.col("wk_end_date").isNotNull())
        .withColumn("rn", F.row_number().over(pick))
        .filter("rn = 1")
        .select("wk_end_date", "holiday_name", "is_holiday")
    )
