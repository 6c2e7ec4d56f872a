"""Current against suggested schedules, years against each other, and reshaped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.functions.columns import exact_mean, exact_sum, half_up, month_of
from weekwise.functions.ordered import exact_percentiles
from weekwise.operators.kpis import store_month_cost
from weekwise.operators.schedule import moved, weekly_load
from weekwise.params import Params
from weekwise.session import materialize


def _both(schedule: DataFrame, params: Params) -> DataFrame:
    """Weekly load of both schedules with a type tag, from one pass over the rows."""
    both = F.array(
        F.struct(F.lit("Current").alias("schedule_type"), F.col("original_wk_end_date").alias("week")),
        F.struct(F.lit("Suggested").alias("schedule_type"), F.col("suggested_wk_end_date").alias("week")),
    )
    tagged = schedule.select("relay_hours", "store_type", F.explode(both).alias("t")).select(
        "relay_hours", "store_type", "t.*"
    )
    return weekly_load(tagged, params, "week", "schedule_type")


def weekly_hours_compare(schedule: DataFrame, thresholds: DataFrame, params: Params) -> DataFrame:
    """Total hours per week, current and suggested, with the week's cap.

    The cap table hangs off the calendar, one row per week, and is broadcast by size.
    """
    return _both(schedule, params).join(thresholds, "wk_end_date", "left").select(
        "wk_end_date", "schedule_type", "total_hours", "total_cap"
    )


def nm_weekly_hours(schedule: DataFrame, thresholds: DataFrame, params: Params) -> DataFrame:
    """Neighbourhood-market hours per week, current and suggested, with the cap."""
    return (
        _both(schedule.filter(F.col("store_type").isin(*params.nm_store_types)), params)
        .join(thresholds, "wk_end_date", "left")
        .select("wk_end_date", "schedule_type", "nm_hours", "nm_cap")
    )


def moves_by_dept(schedule: DataFrame, relays: DataFrame) -> DataFrame:
    """Moved rows per department; the department is joined back from the relay week.

    Moves are counted per relay week first, so the join sees one row for each.
    They are stored: where they are few, Spark knows it and leaves out other
    relay weeks as they are read, before anything is shuffled.
    """
    week = ["relay_id", "wk_end_date"]
    per_relay = (
        moved(schedule)
        .groupBy("relay_id", F.col("original_wk_end_date").alias("wk_end_date"))
        .agg(F.count("*").alias("n"))
    )
    per_relay = materialize(per_relay, "moves-by-relay")
    of_moved = relays.select(*week, "dept_cat").join(per_relay.select(*week), week, "left_semi")
    return (
        per_relay.join(of_moved, week)
        .filter(F.col("dept_cat").isNotNull())
        .groupBy("dept_cat")
        .agg(F.sum("n").alias("moves"))
    )


def _relay_years(relays: DataFrame) -> DataFrame:
    """Distinct (department, relay) of the latest year and of the one before."""
    latest = relays.agg(F.max("relay_year")).scalar()
    return (
        relays.filter(F.col("dept_cat").isNotNull())
        .filter((F.col("relay_year") == latest) | (F.col("relay_year") == latest - 1))
        .select("dept_cat", "relay_id", (F.col("relay_year") == latest).alias("is_latest"))
        .distinct()
    )


def dept_yoy(relays: DataFrame) -> DataFrame:
    """Distinct relays per department, latest year against the one before, 0 where one side is missing."""
    counts = _relay_years(relays).groupBy("dept_cat", "is_latest").agg(F.count("relay_id").alias("n"))
    this_year = counts.filter("is_latest").select("dept_cat", F.col("n").alias("this_year"))
    last_year = counts.filter("NOT is_latest").select("dept_cat", F.col("n").alias("last_year"))
    return this_year.join(last_year, "dept_cat", "full_outer").select(
        "dept_cat",
        F.coalesce("this_year", F.lit(0)).alias("this_year"),
        F.coalesce("last_year", F.lit(0)).alias("last_year"),
        (F.coalesce("this_year", F.lit(0)) - F.coalesce("last_year", F.lit(0))).alias("change"),
    )


def new_relays(relays: DataFrame) -> DataFrame:
    """Relays of the latest year that the year before did not have, with their department and weeks."""
    latest = relays.agg(F.max("relay_year")).scalar()
    known = relays.filter(F.col("dept_cat").isNotNull())
    before = known.filter(F.col("relay_year") == latest - 1).select("relay_id").distinct()
    return (
        known.filter(F.col("relay_year") == latest)
        .select("relay_id", "dept_cat", "wk_end_date")
        .join(before, "relay_id", "left_anti")
        .distinct()
    )


def before_after(costs: DataFrame, params: Params, share: float = 0.8) -> DataFrame:
    """Total, mean and number of rows above the own 80th percentile, per scenario in long form.

    `costs` has a column per scenario; percentiles are exact, and each of the
    three passes over the rows serves both scenarios.
    """
    scenarios = {"Baseline": "baseline_cost", "Optimized": "optimized_cost"}
    cuts = exact_percentiles(costs, list(scenarios.values()), share, fanout=params.percentile_fanout)
    found = []
    for (name, cost), cut in zip(scenarios.items(), cuts):
        measures = {
            "total_cost": exact_sum(cost),
            "mean_cost": exact_mean(cost),
            "rows_above_p80": F.count(F.when(F.col(cost) > F.lit(cut), 1)).cast("double"),
        }
        found += [F.struct(F.lit(name).alias("scenario"), F.lit(m).alias("metric"), e.alias("value")) for m, e in measures.items()]
    return costs.agg(F.array(*found).alias("all")).select(F.explode("all").alias("m")).select("m.*")


def schedule_costs(schedule: DataFrame, params: Params) -> DataFrame:
    """Cost of every scheduled row, and the same plus the move cost where it moved."""
    was_moved = ~F.col("suggested_wk_end_date").eqNullSafe(F.col("original_wk_end_date"))
    moving = F.when(was_moved, F.lit(params.move_cost)).otherwise(F.lit(0.0))
    return schedule.select(
        F.col("total_cost").alias("baseline_cost"), half_up(F.col("total_cost") + moving, 2).alias("optimized_cost")
    )


def _pivot(long: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    return long.groupBy(row).pivot(column, names).agg(F.first(value)).fillna(0.0, subset=names)


def hours_heatmap(placed: DataFrame, weeks: DataFrame) -> DataFrame:
    """Store by week, hours, 0 where a store has no work.

    The hours are added up in long form; the pivot spreads one row per cell.
    Its columns are the calendar weeks, an explicit list bounded by the span
    of dates.
    """
    names = [r[0] for r in weeks.select(F.col("wk_end_date").cast("string")).orderBy("wk_end_date").collect()]
    long = (
        placed.filter(F.col("store_id").isNotNull())
        .groupBy("store_id", F.col("wk_end_date").cast("string").alias("week"))
        .agg(exact_sum("relay_hours").alias("hours"))
    )
    return _pivot(long, "store_id", "week", "hours", names)


def store_month_pivot(scored: DataFrame, weeks: DataFrame, n_stores: int = 20) -> DataFrame:
    """Top stores by month, cost, 0 where there is none."""
    months = weeks.select(month_of(F.col("wk_end_date")).alias("month")).distinct().orderBy("month")
    names = [r[0] for r in months.collect()]
    return _pivot(store_month_cost(scored, n_stores).drop("associate_hours"), "store_id", "month", "total_cost", names)
