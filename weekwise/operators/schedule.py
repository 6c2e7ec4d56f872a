"""Weekly caps, overage and checks of a schedule.

A schedule has one row per instance: relay_id, store_id,
original_wk_end_date, suggested_wk_end_date, relay_hours, store_type,
cannot_move, adjustment_group_id. Week-grain frames hang off the calendar,
so they have at most one row per week.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.functions.columns import decimal_sum, exact_sum, half_up, percent, project_existing
from weekwise.operators.calendar import holiday_weeks, week_calendar
from weekwise.operators.master import INSTANCE
from weekwise.params import Params
from weekwise.session import materialize

REQUIRED = ["relay_id", "store_id", "original_wk_end_date", "relay_hours"]
OPTIONAL = ["store_type", "cannot_move", "adjustment_group_id", "requested_move_wk", "status"]
EXTRA = ["total_cost"]  # carried along where instances have it
CHECKED = [*REQUIRED, "store_type", "cannot_move", "suggested_wk_end_date"]  # what compliance_summary reads


def fallback_schedule(instances: DataFrame) -> DataFrame:
    """Schedule that leaves every instance where it is."""
    return project_existing(instances, REQUIRED, [*OPTIONAL, *EXTRA]).withColumn(
        "suggested_wk_end_date", F.col("original_wk_end_date")
    )


def requested_schedule(instances: DataFrame, params: Params) -> DataFrame:
    """Schedule that grants every instance the pending request it kept."""
    asked = (F.col("status") == params.pending_label) & F.col("requested_move_wk").isNotNull()
    return fallback_schedule(instances).withColumn(
        "suggested_wk_end_date", F.when(asked, F.col("requested_move_wk")).otherwise(F.col("original_wk_end_date"))
    )


def weekly_load(placed: DataFrame, params: Params, week: str = "original_wk_end_date", *by: str) -> DataFrame:
    """Total and neighbourhood-market hours per week, and per `by` columns."""
    is_nm = F.col("store_type").isin(*params.nm_store_types)
    return (
        placed.filter(F.col(week).isNotNull())
        .groupBy(F.col(week).alias("wk_end_date"), *by)
        .agg(
            exact_sum("relay_hours").alias("total_hours"),
            exact_sum(F.when(is_nm, F.col("relay_hours"))).alias("nm_hours"),
            F.count(F.when(is_nm, 1)).alias("nm_rows"),
        )
    )


def caps_from_params(bounds: DataFrame, params: Params) -> DataFrame:
    """The configured caps as a one-row frame."""
    n = params.nm_stores_per_week
    return bounds.select(
        F.lit(params.total_cap).alias("total_cap"),
        F.lit(params.total_cap_holiday).alias("total_cap_holiday"),
        F.lit(params.nm_cap_per_store * n).alias("nm_cap"),
        F.lit(params.nm_cap_per_store_holiday * n).alias("nm_cap_holiday"),
    )


def caps_from_load(load: DataFrame, headroom: float = 1.05, holiday_share: float = 0.9) -> DataFrame:
    """Caps a little above the mean week, for data on which the configured caps never bind."""

    def cap(mean):
        return F.coalesce(F.floor(mean * headroom).cast("double"), F.lit(0.0))

    return (
        load.agg(
            (F.sum(F.col("total_hours").cast("decimal(20,2)")).cast("double") / F.count("*")).alias("mean_total"),
            (
                F.sum(F.col("nm_hours").cast("decimal(20,2)")).cast("double")
                / F.count(F.when(F.col("nm_rows") > 0, 1))
            ).alias("mean_nm"),
        )
        .select(cap(F.col("mean_total")).alias("total_cap"), cap(F.col("mean_nm")).alias("nm_cap"))
        .select(
            "total_cap",
            F.floor(F.col("total_cap") * holiday_share).cast("double").alias("total_cap_holiday"),
            "nm_cap",
            F.floor(F.col("nm_cap") * holiday_share).cast("double").alias("nm_cap_holiday"),
        )
    )


def weekly_thresholds(calendar: DataFrame, holidays: DataFrame, caps: DataFrame) -> DataFrame:
    """Caps of every calendar week, lower in holiday weeks."""

    def scalar(name: str):
        return caps.select(name).scalar()

    flagged = calendar.join(holiday_weeks(holidays).select("wk_end_date", "is_holiday"), "wk_end_date", "left")
    return flagged.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False))).withColumns(
        {
            "total_cap": F.when(F.col("is_holiday"), scalar("total_cap_holiday")).otherwise(scalar("total_cap")),
            "nm_cap": F.when(F.col("is_holiday"), scalar("nm_cap_holiday")).otherwise(scalar("nm_cap")),
        }
    )


def thresholds_for(tables, params: Params, caps: DataFrame) -> DataFrame:
    return weekly_thresholds(week_calendar(tables.week_bounds, params), tables.holidays, caps)


def weekly_overage(load: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Hours over cap and slack below it, for every calendar week; a week exactly at cap has neither.

    A loaded week outside the calendar keeps its row, without a cap.
    """
    joined = thresholds.join(load.drop("nm_rows"), "wk_end_date", "full_outer").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("total_hours", "nm_hours")}
    )

    def above(a: str, b: str):
        return F.greatest(F.lit(0.0), F.col(a) - F.coalesce(F.col(b), F.col(a)))

    return joined.withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False))).withColumns(
        {
            "total_over": above("total_hours", "total_cap"),
            "nm_over": above("nm_hours", "nm_cap"),
            "total_slack": F.greatest(F.lit(0.0), F.coalesce(F.col("total_cap") - F.col("total_hours"), F.lit(0.0))),
            "nm_slack": F.greatest(F.lit(0.0), F.coalesce(F.col("nm_cap") - F.col("nm_hours"), F.lit(0.0))),
        }
    )


def moved(schedule: DataFrame) -> DataFrame:
    """Rows whose suggested week differs; two missing weeks count as equal."""
    return schedule.filter(~F.col("suggested_wk_end_date").eqNullSafe(F.col("original_wk_end_date")))


def week_pairs(schedule: DataFrame, params: Params) -> DataFrame:
    """Rows and hours per original and suggested week: what loads and moves of a schedule add up to.

    One pass over the rows gives at most a row per pair of weeks; the hours stay decimal, so that sums of them are exact.
    """
    is_nm = F.col("store_type").isin(*params.nm_store_types)
    return schedule.groupBy("original_wk_end_date", "suggested_wk_end_date").agg(
        decimal_sum("relay_hours").alias("total_hours"),
        decimal_sum(F.when(is_nm, F.col("relay_hours"))).alias("nm_hours"),
        F.count(F.when(is_nm, 1)).alias("nm_rows"),
        F.count("*").alias("n_rows"),
    )


def fallback_pairs(pairs: DataFrame) -> DataFrame:
    """The week pairs of the schedule that leaves every instance where it is."""
    return pairs.withColumn("suggested_wk_end_date", F.col("original_wk_end_date"))


def schedule_objective(schedule: DataFrame, thresholds: DataFrame, params: Params, label: str) -> DataFrame:
    """Move costs plus penalties on hours over the caps, one row."""
    return pairs_objective(materialize(week_pairs(schedule, params), "week-pairs"), thresholds, params, label)


def pairs_objective(pairs: DataFrame, thresholds: DataFrame, params: Params, label: str) -> DataFrame:
    """The objective of a schedule from its week pairs, stored."""
    load = (
        pairs.filter(F.col("suggested_wk_end_date").isNotNull())
        .groupBy(F.col("suggested_wk_end_date").alias("wk_end_date"))
        .agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in ("total_hours", "nm_hours")], F.sum("nm_rows").alias("nm_rows"))
    )
    over = weekly_overage(load, thresholds).agg(
        exact_sum("total_over").alias("total_over"), exact_sum("nm_over").alias("nm_over")
    )
    moves = moved(pairs).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    return over.select(
        F.lit(label).alias("schedule"),
        moves.alias("moves"),
        "total_over",
        "nm_over",
    ).withColumn(
        "objective",
        half_up(
            F.col("moves") * params.move_cost
            + F.col("total_over") * params.over_penalty
            + F.col("nm_over") * params.nm_over_penalty,
            2,
        ),
    )


def assignment_violations(assignments: DataFrame) -> DataFrame:
    """Instances that are not in exactly one week. Input: instance columns and `suggested_wk_end_date`."""
    return (
        assignments.groupBy(*INSTANCE)
        .agg(F.count_distinct("suggested_wk_end_date").alias("assigned_weeks"))
        .filter(F.col("assigned_weeks") != 1)
    )


def requested_assignment_violations(placed: DataFrame, requests: DataFrame) -> DataFrame:
    """The same check if every request were granted: an instance goes to each requested week of its relay.

    The weeks are counted per relay before the join, so instances are not
    multiplied by them; without a request an instance has its own week.
    """
    asked = requests.groupBy("relay_id").agg(F.count_distinct("requested_move_wk").alias("asked_weeks"))
    return (
        placed.select(*INSTANCE)
        .join(asked, "relay_id", "left")
        .withColumn("assigned_weeks", F.greatest(F.lit(1), F.coalesce("asked_weeks", F.lit(1))).cast("bigint"))
        .filter(F.col("assigned_weeks") != 1)
        .drop("asked_weeks")
    )


def cannot_move_violations(schedule: DataFrame) -> DataFrame:
    return moved(schedule).filter(F.col("cannot_move")).select(
        "relay_id", "store_id", "original_wk_end_date", "suggested_wk_end_date"
    )


def group_sync_violations(schedule: DataFrame, groups: DataFrame, week: str = "suggested_wk_end_date") -> DataFrame:
    """Group weeks in which the members' placed counts differ; an absent member counts 0.

    Absence shows in the number of members present, so no zero rows are made.
    Relays without a group are left out before the rows are counted.
    """
    members = groups.select("adjustment_group_id", "relay_id").distinct()
    size = members.groupBy("adjustment_group_id").agg(F.count("*").alias("members"))
    placed = (
        schedule.filter(F.col(week).isNotNull())
        .join(groups.select("relay_id"), "relay_id", "left_semi")
        .groupBy("relay_id", F.col(week).alias("wk_end_date"))
        .agg(F.count("*").alias("n"))
    )
    per_week = (
        placed.join(members, "relay_id")
        .groupBy("adjustment_group_id", "wk_end_date")
        .agg(F.count("*").alias("present"), F.min("n").alias("lowest"), F.max("n").alias("highest"))
    )
    return (
        per_week.join(size, "adjustment_group_id")
        .withColumn("lowest", F.when(F.col("present") < F.col("members"), F.lit(0)).otherwise(F.col("lowest")))
        .filter(F.col("lowest") != F.col("highest"))
        .select("adjustment_group_id", "wk_end_date", "lowest", "highest")
    )


def split_groups(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """Group weeks whose instances a plan sends to different weeks, for every group of a relay."""
    members = groups.select("adjustment_group_id", "relay_id").distinct()
    rows = plan.filter(F.col("original_wk_end_date").isNotNull()).select(
        "relay_id", "original_wk_end_date", "suggested_wk_end_date"
    )
    return (
        rows.join(members, "relay_id")
        .groupBy("adjustment_group_id", "original_wk_end_date")
        .agg(F.min("suggested_wk_end_date").alias("first"), F.max("suggested_wk_end_date").alias("last"))
        .filter("first <> last")
    )


def group_sync_changes(plans: dict[str, DataFrame], groups: DataFrame) -> DataFrame:
    """Per plan: group weeks out of step before and after it, and group weeks that it tears apart."""

    def count(label: str, plan: DataFrame) -> DataFrame:
        before = group_sync_violations(plan, groups, "original_wk_end_date")
        return before.agg(F.count("*").alias("before")).select(
            F.lit(label).alias("plan"),
            "before",
            group_sync_violations(plan, groups).agg(F.count("*")).scalar().alias("after"),
            split_groups(plan, groups).agg(F.count("*")).scalar().alias("split_weeks"),
        )

    return reduce(DataFrame.unionByName, [count(k, v) for k, v in plans.items()])


def moved_relays(schedule: DataFrame) -> DataFrame:
    return moved(schedule).select(
        "relay_id", "store_id", "store_type", "relay_hours", "original_wk_end_date", "suggested_wk_end_date"
    )


def move_request_match(schedule: DataFrame, requests: DataFrame, params: Params) -> DataFrame:
    """Moved rows with the requests of their relay, and whether the move meets a pending one.

    A request holds for all stores of its relay, whatever its status. The
    inner part can be split on either side where a relay is hot; rows
    without a request are added from an anti join.
    """
    asked = requests.filter(F.col("relay_id").isNotNull()).select(
        "relay_id",
        F.col("request_id").alias("req_id"),
        F.col("request_type").alias("req_type"),
        F.col("status").alias("req_status"),
        F.col("requested_move_wk").alias("req_week"),
    )
    rows = moved_relays(schedule)
    with_request = rows.join(asked, "relay_id")
    without = rows.join(asked.select("relay_id").distinct(), "relay_id", "left_anti")
    met = (F.col("req_status") == params.pending_label) & (F.col("suggested_wk_end_date") == F.col("req_week"))
    return with_request.unionByName(without, allowMissingColumns=True).withColumn(
        "matches_request", F.coalesce(met, F.lit(False))
    )


def request_compliance(schedule: DataFrame, requests: DataFrame, params: Params) -> DataFrame:
    """Share of moved rows' pending requests that the suggestion meets, by request type."""
    return (
        move_request_match(schedule, requests, params)
        .filter(F.col("req_status") == params.pending_label)
        .groupBy(F.col("req_type").alias("request_type"))
        .agg(
            F.count("*").alias("requests"),
            F.count(F.when(F.col("matches_request"), 1)).alias("met"),
        )
        .withColumn("compliance_pct", percent(F.col("met"), F.col("requests")))
    )


def compliance_summary(schedule: DataFrame, thresholds: DataFrame, groups: DataFrame, params: Params) -> DataFrame:
    """Violations per constraint class."""
    over = weekly_overage(weekly_load(schedule, params, "suggested_wk_end_date"), thresholds)

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_class"), "violations")

    weeks = over.agg(
        F.count(F.when(F.col("total_over") > 0, 1)).alias("weekly_hours"),
        F.count(F.when(F.col("nm_over") > 0, 1)).alias("nm_weekly_hours"),
    ).unpivot([], ["weekly_hours", "nm_weekly_hours"], "constraint_class", "violations")
    return reduce(
        DataFrame.unionByName,
        [
            weeks,
            count(assignment_violations(schedule), "assignment"),
            count(cannot_move_violations(schedule), "cannot_move"),
            count(group_sync_violations(schedule, groups), "group_sync"),
        ],
    )


def dept_load(placed: DataFrame) -> DataFrame:
    """Each department's share of a week's hours, from one row per (week, department)."""
    per_dept = (
        placed.filter(F.col("dept_cat").isNotNull() & F.col("wk_end_date").isNotNull())
        .groupBy("wk_end_date", "dept_cat")
        .agg(exact_sum("relay_hours").alias("dept_hours"))
    )
    per_week = per_dept.groupBy("wk_end_date").agg(exact_sum("dept_hours").alias("week_hours"))
    return per_dept.join(per_week, "wk_end_date").withColumn(
        "share_pct", percent(F.col("dept_hours"), F.col("week_hours"), 4)
    )
