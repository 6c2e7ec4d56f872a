"""Every registered query: (spark, folder of parquet files) -> DataFrame.

Queries read whole tables. Dates leave as ISO text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwise.functions.columns import project_existing
from weekwise.functions.skew import hot_keys
from weekwise.operators import calendar, compare, forecast, kpis, master, quality, rebalance, requests, schedule
from weekwise.params import Params
from weekwise.session import FREED, configure, for_tables, materialize, scratch_path, stored_bytes
from weekwise.sources import adapters, io
from weekwise.sources.stages import Stages, file_fingerprint
from weekwise.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCENARIOS = {"tight": 0.9, "current": 1.0, "loose": 1.1}


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            changed[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumns(changed) if changed else df


@dataclass(frozen=True)
class Context:
    """Tables of one folder and the frames most queries start from."""

    spark: SparkSession
    sf_dir: str
    params: Params
    stored: DataFrame | None = None  # placed rows, where a query has stored them for its instances too

    @cached_property
    def tables(self):
        return adapters.load_tables(self.spark, self.sf_dir)

    @cached_property
    def placed(self) -> DataFrame:
        t = self.tables
        return master.relay_store_join(t.relays, t.bridge, self.params)

    @cached_property
    def scored(self) -> DataFrame:
        return master.scored_schedule(self.tables, self.params)

    def load(self) -> DataFrame:
        """Weekly load, stored: one row per week that several parts of a query read."""
        return materialize(schedule.weekly_load(self.placed, self.params), "load")

    def thresholds(self, load: DataFrame) -> DataFrame:
        return schedule.thresholds_for(self.tables, self.params, schedule.caps_from_load(load))

    def instance_rows(self, with_cost: bool = False) -> DataFrame:
        """Schedule columns of the instances; the adapters group by the instance key."""
        t = self.tables
        if with_cost:
            t = replace(t, relays=master.move_cost(master.with_hours(t.relays), self.params))
        rows = master.instances(t, self.params, unique_keys=True, placed=self.stored)
        return project_existing(rows, schedule.REQUIRED, [*schedule.OPTIONAL, *(schedule.EXTRA if with_cost else ())])

    def instances(self, with_cost: bool = False) -> DataFrame:
        """The same rows, stored."""
        return materialize(self.instance_rows(with_cost), "instances")

    def limits(self, instances: DataFrame) -> DataFrame:
        """Stored weekly thresholds for a stored schedule."""
        load = materialize(schedule.weekly_load(instances, self.params), "load")
        return materialize(self.thresholds(load), "thresholds")

    @property
    def open_from(self):
        return calendar.first_open_week(self.tables.week_bounds, self.params)

    def plan(self, parts: DataFrame | None = None, with_cost: bool = False) -> tuple[DataFrame, DataFrame]:
        """Stored thresholds and the suggested schedule."""
        rows = self.instances(with_cost)
        limits = self.limits(rows)
        return limits, self.suggest(rows, limits, parts)

    def suggest(self, rows: DataFrame, limits: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """The suggested schedule of stored instances and thresholds."""
        return rebalance.rebalance(rows, limits, self.params, open_from=self.open_from, parts=parts)

    def objectives(self, unmoved: str) -> tuple[DataFrame, DataFrame]:
        """Objective of the schedule as it is, under that label, and as suggested: both from one pass over its rows."""
        limits, suggested = self.plan()
        pairs = materialize(schedule.week_pairs(suggested, self.params), "week-pairs")
        before = schedule.pairs_objective(schedule.fallback_pairs(pairs), limits, self.params, unmoved)
        return before, schedule.pairs_objective(pairs, limits, self.params, "Suggested")

    def benefit(self) -> DataFrame:
        before, after = self.objectives("Baseline")
        weeks = calendar.week_calendar(self.tables.week_bounds, self.params)
        return materialize(forecast.cost_benefit(before, after, weeks, self.params), "benefit")


def query(fn: Callable[[Context], DataFrame], more: dict[str, str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size = stored_bytes(spark, *[f"{sf_dir}/{name}.parquet" for name in adapters.RAW])
        return iso_dates(fn(Context(configure(spark, {**for_tables(size), **(more or {})}), sf_dir, Params())))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def staged_query(fn: Callable[[Context], DataFrame]):
    """A query that stores its large steps and keeps no shuffle files of those that are done."""
    return query(fn, FREED)


# -- sources and sinks ----------------------------------------------------


@query
def load_tables(c):
    return io.row_counts(c.tables)


@query
def sql_source(c):
    return io.sql_source(
        c.spark,
        "SELECT dept_cat, relay_year, count(*) AS relay_count, sum(total_store_hours) AS hours "
        "FROM {relays} GROUP BY dept_cat, relay_year",
        relays=c.tables.relays,
    )


@query
def checkpoint_roundtrip(c):
    cols = ["relay_id", "store_id", "wk_end_date", "dept_cat", "relay_hours", "cannot_move", "relay_year"]
    return io.checkpoint_roundtrip(c.placed.select(*cols), ["relay_year"])


@staged_query
def dashboard_document(c):
    t = c.tables
    as_of = calendar.as_of_date(t.week_bounds, c.params)
    top = materialize(master.top_cost(master.costed_relays(t.relays, c.params)), "top-cost")
    # Six parts of the document and the instances behind its savings read the scored rows: they are joined once.
    cols = ["relay_id", "store_id", "wk_end_date", "dept_cat", "relay_hours", "total_cost", "risk_score", "store_type", "cannot_move"]
    scored = materialize(master.scored_schedule(t, c.params, top).select(*cols), "scored")
    placed = scored.withColumn("original_wk_end_date", F.col("wk_end_date"))
    benefit = replace(c, stored=placed).benefit()
    return kpis.dashboard_document(scored, t.requests, benefit, forecast.weekly_cost(scored), as_of, c.params)


@query
def text_import(c):
    """Requests through a careless text export and back."""
    path = io.export_csv(adapters.request_text(c.tables.requests), scratch_path(c.spark, "text"))
    return io.load_text(c.spark, path, "requests").select("request_id", "relay_id", "store_id", "requested_move_wk", "status")


@query
def resumed_stages(c):
    """Stages of a run, of the same run again, and of one with a dearer move."""
    folder = scratch_path(c.spark, "stages")
    files = file_fingerprint(c.spark, *[f"{c.sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier", "orders", "customer")])

    def run(params: Params) -> dict[str, tuple[int, bool]]:
        stages = Stages(c.spark, folder)
        d = replace(c, params=params)
        rows = stages.run("instances", d.instance_rows, files=files)
        load = stages.run("load", lambda: schedule.weekly_load(rows, params), after=("instances",))
        limits = stages.run("thresholds", lambda: d.thresholds(load), after=("load",))
        kept = schedule.fallback_schedule(rows)
        stages.run("suggested", lambda: d.suggest(rows, limits), after=("instances", "thresholds"), like=kept, move_cost=params.move_cost)
        return stages.outcome

    runs = [run(p) for p in (c.params, c.params, replace(c.params, move_cost=2 * c.params.move_cost))]
    rows = [(name, n, *(r[name][1] for r in runs)) for name, (n, _) in runs[0].items()]
    return c.spark.createDataFrame(rows, "stage string, row_count bigint, first boolean, again boolean, dearer boolean")


@query
def csv_export(c):
    return io.csv_export(kpis.store_performance(c.scored))


# -- flags, keys, filters -------------------------------------------------


@query
def relay_flags(c):
    cols = ["relay_id", "wk_end_date", "is_seasonal", "is_dc_realign", "cannot_move", "relay_year"]
    return master.relay_flags(c.tables.relays, c.params).select(*cols)


@query
def instance_key(c):
    return master.with_instance_key(c.placed).select("instance_key", "relay_hours")


@query
def optim_scope(c):
    return master.optim_scope(c.placed, c.tables.week_bounds, c.params).select(
        "relay_id", "store_id", "original_wk_end_date", "relay_hours"
    )


@query
def pending_requests(c):
    return requests.pending_requests(c.tables.requests, c.params)


# -- joins ----------------------------------------------------------------


@query
def relay_store_join(c):
    return c.placed.select("relay_id", "wk_end_date", "store_id", "store_type", "dept_cat", "relay_hours", "cannot_move")


@query
def holiday_flags(c):
    return master.holiday_flags(c.placed, c.tables.holidays).select(
        "relay_id", "store_id", "wk_end_date", "is_holiday", "holiday_name"
    )


@query
def group_join(c):
    return master.group_join(c.placed, c.tables.groups).select(
        "relay_id", "store_id", "wk_end_date", "adjustment_group_id"
    )


@query
def request_join(c):
    """The joined rows, counted by what the join added."""
    requests_ = c.tables.requests
    return (
        master.request_join(c.placed, requests_, hot_keys(requests_, "relay_id"))
        .groupBy("store_type", "request_type", "status", "requested_move_wk")
        .agg(F.count("*").alias("row_count"), F.sum("relay_hours").alias("hours"))
    )


@query
def move_request_match(c):
    _, suggested = c.plan()
    return schedule.move_request_match(suggested, c.tables.requests, c.params)


@query
def dept_yoy(c):
    return compare.dept_yoy(c.tables.relays)


@query
def new_relays(c):
    return compare.new_relays(c.tables.relays)


@query
def store_month_cost(c):
    return kpis.store_month_cost(c.scored)


@query
def move_candidates(c):
    rows = c.instances()
    return rebalance.move_candidates(rows, c.limits(rows), c.params)


@query
def master_schedule(c):
    return master.master_schedule(c.tables, c.params).select(
        "relay_id",
        "store_id",
        "original_wk_end_date",
        "store_type",
        "dept_cat",
        "relay_hours",
        "relay_change_perc",
        "is_holiday",
        "cannot_move",
        "adjustment_group_id",
        "request_type",
        "requested_move_wk",
        "status",
    )


# -- aggregates -----------------------------------------------------------


def _overactive(c):
    t = c.tables
    return kpis.overactive_groups(c.placed, t.groups, t.requests, c.params)


@query
def overactive_groups(c):
    return _overactive(c)


@query
def overactive_measures(c):
    return kpis.overactive_measures(_overactive(c), c.params)


@query
def request_frequency(c):
    return requests.request_frequency(c.tables.requests)


@query
def status_breakdown(c):
    return requests.status_breakdown(c.tables.requests)


@query
def master_status(c):
    t = c.tables
    return requests.master_status(c.placed, t.groups, t.requests)


@query
def request_seasonality(c):
    return requests.request_seasonality(c.tables.requests)


@query
def exec_summary(c):
    return kpis.exec_summary(c.scored, c.tables.requests, c.params)


@query
def store_performance(c):
    return kpis.store_performance(c.scored)


@query
def department_breakdown(c):
    return kpis.department_breakdown(c.scored)


@query
def reason_summary(c):
    return kpis.reason_summary(c.scored)


@query
def dept_month_moves(c):
    return kpis.dept_month_moves(c.scored)


@query
def dept_risk_matrix(c):
    return kpis.dept_risk_matrix(c.scored)


@query
def dept_summary(c):
    return kpis.dept_summary(c.scored)


@query
def kpi_metrics(c):
    return kpis.kpi_metrics(c.scored, c.params)


@query
def plan_kpis(c):
    return kpis.plan_kpis(c.scored, c.benefit(), c.params)


@query
def weekly_hours_compare(c):
    limits, suggested = c.plan()
    return compare.weekly_hours_compare(suggested, limits, c.params)


@query
def nm_weekly_hours(c):
    limits, suggested = c.plan()
    return compare.nm_weekly_hours(suggested, limits, c.params)


@query
def moves_by_dept(c):
    _, suggested = c.plan()
    return compare.moves_by_dept(suggested, c.tables.relays)


@query
def merchant_scorecard(c):
    return requests.merchant_scorecard(c.tables.requests, c.params)


@query
def seasonal_patterns(c):
    return requests.seasonal_patterns(c.tables.requests)


@query
def before_after(c):
    _, suggested = c.plan(with_cost=True)
    return compare.before_after(materialize(compare.schedule_costs(suggested, c.params), "costs"), c.params)


@query
def high_frequency_stores(c):
    return kpis.high_frequency_stores(c.scored, c.params)


@query
def dept_imbalance(c):
    return kpis.dept_imbalance(c.scored, c.params)


@query
def request_status_cards(c):
    return requests.request_status_cards(c.tables.requests, c.params)


# -- data quality ---------------------------------------------------------


@query
def dq_completeness(c):
    t = c.tables
    linked = t.relays.select("relay_id", "dept_cat").join(
        master.best_request(t.requests), "relay_id", "left"
    ).join(master.first_group(t.groups), "relay_id", "left")
    return quality.dq_completeness({**t.named(), "linked_relays": linked}, c.params)


@query
def dq_volume(c):
    return quality.dq_volume(c.tables.named())


@query
def dq_histogram(c):
    t = c.tables
    return quality.dq_histograms({"relays": t.relays, "stores": t.stores, "bridge": t.bridge, "requests": t.requests})


@query
def risk_histogram(c):
    return quality.risk_histogram(c.scored)


@query
def dq_freshness(c):
    t = c.tables
    stamped = {
        "relays": (t.relays, "wk_end_date"),
        "bridge": (t.bridge, "wk_end_date"),
        "requests": (t.requests, "request_ts"),
        "holidays": (t.holidays, "wk_end_date"),
    }
    return quality.dq_freshness(stamped, t.week_bounds, c.params)


@query
def dq_orphans(c):
    return quality.dq_orphans(c.tables)


@query
def dq_rules(c):
    return quality.dq_rules(c.tables, c.params)


# -- cost, risk, insight --------------------------------------------------


@query
def move_cost(c):
    return master.move_cost(c.placed, c.params).select(
        "relay_id", "store_id", "wk_end_date", "labour_cost", "setup_cost", "material_cost", "total_cost"
    )


@query
def risk_score(c):
    return c.scored.select("relay_id", "store_id", "wk_end_date", "total_cost", "risk_score", "risk_category")


@query
def cost_analysis(c):
    return kpis.cost_analysis(c.scored, c.params)


@query
def predictive_insights(c):
    return kpis.predictive_insights(c.scored, c.params)


@query
def peak_weeks(c):
    return forecast.peak_weeks(forecast.weekly_cost(c.scored))


@query
def opportunities(c):
    return kpis.opportunities(c.scored, c.params)


@query
def cost_waterfall(c):
    return forecast.cost_waterfall(c.benefit())


@query
def roi_timeline(c):
    return forecast.roi_timeline(c.benefit(), c.params)


@query
def weekly_forecast(c):
    return forecast.weekly_forecast(forecast.weekly_cost(c.scored), c.tables.week_bounds, c.params)


@query
def kpi_trend(c):
    return forecast.kpi_trend(forecast.weekly_cost(c.scored))


@query
def cost_roi_quadrants(c):
    costs = materialize(forecast.cost_roi(c.scored, c.tables.requests), "cost-roi")
    return forecast.cost_roi_quadrants(costs, c.params)


@query
def currency_label(c):
    return kpis.currency_label(c.scored)


@query
def what_if_thresholds(c):
    load = c.load()
    return forecast.what_if_thresholds(schedule.weekly_overage(load, c.thresholds(load)), SCENARIOS, c.params)


# -- windows, top-k, reshape ----------------------------------------------


@query
def dedupe_instances(c):
    return master.instances(c.tables, c.params).select(
        *master.INSTANCE, "relay_hours", "adjustment_group_id", "request_type", "requested_move_wk", "status"
    )


@staged_query
def key_suffix(c):
    placed = materialize(c.placed.select(*master.INSTANCE), "placed")
    keyed = master.with_instance_key(master.group_join(placed, c.tables.groups))
    return master.key_suffix(keyed.select("instance_key", "adjustment_group_id"), c.params)


@query
def duplicate_keys(c):
    return master.duplicate_keys(master.with_instance_key(master.group_join(c.placed, c.tables.groups)))


@query
def top_risk(c):
    return kpis.top_risk(c.scored)


@query
def top_stores(c):
    return kpis.top_stores(c.scored, 10)


@query
def hours_heatmap(c):
    return compare.hours_heatmap(c.placed, calendar.week_calendar(c.tables.week_bounds, c.params))


@query
def store_month_pivot(c):
    return compare.store_month_pivot(c.scored, calendar.week_calendar(c.tables.week_bounds, c.params))


# -- scheduling -----------------------------------------------------------


@query
def week_calendar(c):
    return calendar.week_calendar(c.tables.week_bounds, c.params)


@query
def holiday_calendar(c):
    return c.tables.holidays


@query
def weekly_thresholds(c):
    return c.thresholds(c.load())


@query
def weekly_overage(c):
    load = c.load()
    return schedule.weekly_overage(load, c.thresholds(load))


@query
def schedule_objective(c):
    before, after = c.objectives("Current")
    return before.unionByName(after)


@query
def assignment_violations(c):
    return schedule.requested_assignment_violations(c.placed, c.tables.requests)


@query
def cannot_move_violations(c):
    return schedule.cannot_move_violations(
        schedule.requested_schedule(master.instances(c.tables, c.params, unique_keys=True), c.params)
    )


@query
def group_sync_violations(c):
    return schedule.group_sync_violations(c.placed, c.tables.groups, "original_wk_end_date")


@query
def rebalance_schedule(c):
    return c.plan()[1].select(
        "relay_id", "store_id", "original_wk_end_date", "suggested_wk_end_date", "relay_hours", "store_type", "cannot_move"
    )


QUERIES["rebalance"] = QUERIES.pop("rebalance_schedule")


@query
def rebalance_bound(c):
    """Cost of the suggested schedule, a lower bound on that of any, and the gap."""
    limits, suggested = c.plan()
    suggested = materialize(suggested, "suggested")
    cost = schedule.schedule_objective(suggested, limits, c.params, "Suggested").select("objective")
    bound = rebalance.objective_bound(suggested, limits, c.params, open_from=c.open_from)
    return rebalance.optimality_gap(cost, bound)


@query
def group_parts(c):
    return rebalance.group_parts(c.tables.groups)


@query
def synchronised_schedule(c):
    """The suggested schedule if groups with common relays move together."""
    parts = materialize(rebalance.group_parts(c.tables.groups), "group-parts")
    return c.plan(parts)[1].select("relay_id", "store_id", "original_wk_end_date", "suggested_wk_end_date", "relay_hours")


@query
def group_sync_after_plan(c):
    """Group weeks out of step before and after either plan."""
    parts = materialize(rebalance.group_parts(c.tables.groups), "group-parts")
    rows = c.instances()
    limits = c.limits(rows)
    plans = {"First group": c.suggest(rows, limits), "Tied groups": c.suggest(rows, limits, parts)}
    return schedule.group_sync_changes({k: materialize(v, "plan") for k, v in plans.items()}, c.tables.groups)


@query
def fallback_schedule(c):
    return schedule.fallback_schedule(c.placed).select(
        "relay_id", "store_id", "original_wk_end_date", "suggested_wk_end_date", "relay_hours", "store_type", "cannot_move"
    )


@query
def moved_relays(c):
    return schedule.moved_relays(c.plan()[1])


@query
def moved_listing(c):
    """Moved relays as a sorted listing."""
    rows = schedule.moved_relays(c.plan()[1]).select(
        "relay_id", "store_id", "original_wk_end_date", "suggested_wk_end_date", "relay_hours"
    )
    path = io.export_sorted(rows, scratch_path(c.spark, "listing"), "original_wk_end_date", "relay_id", "store_id")
    return io.load_sorted(c.spark, path)


@query
def report_thresholds(c):
    """Caps of every week that a report on both schedules covers."""
    rows = c.instances()
    load = materialize(schedule.weekly_load(rows, c.params), "load")
    limits = materialize(c.thresholds(load), "thresholds")
    suggested = c.suggest(rows, limits)
    bounds = materialize(calendar.report_bounds(c.tables.week_bounds, suggested), "bounds")
    weeks = calendar.week_calendar(bounds, c.params)
    return schedule.weekly_thresholds(weeks, c.tables.holidays, schedule.caps_from_load(load))


@query
def request_compliance(c):
    _, suggested = c.plan()
    return schedule.request_compliance(suggested, c.tables.requests, c.params)


@query
def compliance_summary(c):
    limits, suggested = c.plan()
    # Read five times, so stored, with the columns that its checks read.
    suggested = suggested.select(*schedule.CHECKED)
    return schedule.compliance_summary(materialize(suggested, "suggested"), limits, c.tables.groups, c.params)


@query
def dept_load(c):
    return schedule.dept_load(c.placed)


# -- streaming ------------------------------------------------------------


def _events(c):
    return live.event_stream(c.spark, c.sf_dir, adapters.RAW["events"], "events.parquet")


@query
def stream_counts(c):
    return live.run_updates(live.tumbling_counts(_events(c)), ["window_start", "event_type"])


@query
def stream_latest(c):
    return live.run_updates(live.latest_by_key(_events(c), "user_id"), ["user_id"])


def _deliveries(c):
    feed = materialize(adapters.request_deliveries(c.tables.requests), "deliveries")
    return live.run_deliveries(feed, c.tables.bridge, "delivery")


@query
def stream_requests(c):
    return live.request_summary(_deliveries(c)[0])


@query
def stream_request_intake(c):
    return _deliveries(c)[1]
