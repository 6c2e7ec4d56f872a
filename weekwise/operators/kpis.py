"""Aggregates over the scored schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import exact_mean, exact_sum, half_up, money_label, month_of, percent
from weekwise.operators.forecast import kpi_trend
from weekwise.operators.master import fan_out
from weekwise.params import Params
from weekwise.session import materialize

RISK_SCALE = 4


def overactive_groups(placed: DataFrame, groups: DataFrame, requests: DataFrame, params: Params) -> DataFrame:
    """Per department and year: distinct relays, and rows of the full chain, with a large change.

    Rows are cut to one per (department, year, relay) before they meet the
    fan-out counts, which spreads a hot department and collapses a hot relay.
    """
    per_relay = (
        placed.filter(F.col("relay_change_perc") >= params.change_threshold)
        .filter(F.col("dept_cat").isNotNull() & F.col("relay_year").isNotNull())
        .groupBy("dept_cat", "relay_year", "relay_id")
        .agg(F.count("*").alias("n_placed"))
    )
    weighted = fan_out(per_relay, groups, requests).withColumn("n_rows", F.col("n_placed") * F.col("copies"))
    return weighted.groupBy("dept_cat", "relay_year").agg(
        F.count("relay_id").alias("distinct_relays"),
        F.coalesce(F.sum(F.when(F.col("relay_id").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("relay_rows"),
    )


def overactive_measures(groups: DataFrame, params: Params) -> DataFrame:
    """Departments with a group above the count threshold, those groups' relays, and a 0/1 flag on the row counts."""
    limit = params.group_count_threshold

    def over(col: str):
        return F.when(F.col(col) > limit, F.col(col))

    return groups.agg(
        F.count_distinct(F.when(F.col("distinct_relays") > limit, F.col("dept_cat"))).alias("overactive_group_count"),
        F.coalesce(F.sum(over("distinct_relays")), F.lit(0)).alias("overactive_relay_count"),
        F.when(F.coalesce(F.sum(over("relay_rows")), F.lit(0)) > limit, 1).otherwise(0).alias("overactive_flag"),
    )


def exec_summary(scored: DataFrame, requests: DataFrame, params: Params) -> DataFrame:
    pending = requests.agg(F.count(F.when(F.col("status") == params.pending_label, 1))).scalar()
    return scored.agg(
        F.count("*").alias("total_relays"),
        exact_sum("total_cost").alias("total_cost"),
        F.count(F.when(F.col("risk_score") > params.high_risk, 1)).alias("high_risk_count"),
    ).withColumn("pending_requests", pending)


def store_performance(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("store_id").isNotNull()).groupBy("store_id").agg(
        exact_sum("total_cost").alias("total_cost"),
        exact_mean("risk_score", RISK_SCALE).alias("mean_risk"),
        F.count("*").alias("relay_count"),
    )


def department_breakdown(scored: DataFrame) -> DataFrame:
    """Cost per department with its share, and the total row of `rollup`, which `is_total` tells apart."""
    rolled = (
        scored.filter(F.col("dept_cat").isNotNull())
        .rollup("dept_cat")
        .agg(
            exact_sum("total_cost").alias("total_cost"),
            F.count("*").alias("relay_count"),
            (F.grouping("dept_cat") == 1).alias("is_total"),
        )
        .withColumn("dept_cat", F.coalesce("dept_cat", F.lit("TOTAL")))
    )
    # A row per department: the window over all of them is bounded.
    grand = F.max(F.when(F.col("is_total"), F.col("total_cost"))).over(Window.partitionBy(F.lit(1)))
    return rolled.withColumn("share_pct", percent(F.col("total_cost"), grand))


def reason_summary(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("request_reason").isNotNull()).groupBy("request_reason").agg(
        exact_sum("total_cost").alias("total_cost"),
        F.count("*").alias("relay_count"),
        exact_sum("associate_hours_impact").alias("associate_hours"),
    )


def dept_month_moves(scored: DataFrame) -> DataFrame:
    return (
        scored.filter(F.col("dept_cat").isNotNull() & F.col("wk_end_date").isNotNull())
        .groupBy(month_of(F.col("wk_end_date")).alias("month"), "dept_cat")
        .agg(
            exact_mean("historical_moves_count", 0).alias("mean_prior_moves"),
            exact_sum("total_cost").alias("total_cost"),
        )
    )


def top_stores(scored: DataFrame, n: int) -> DataFrame:
    """The `n` stores with the highest cost; ties by store."""
    return store_performance(scored).orderBy(F.desc("total_cost"), "store_id").limit(n)


def store_month_cost(scored: DataFrame, n_stores: int = 20) -> DataFrame:
    """Cost and associate hours by month for the top stores (semi join on the short list).

    Rows are added up per store and month once; both the list and the result
    come from that small stored table.
    """
    monthly = (
        scored.filter(F.col("store_id").isNotNull())
        .groupBy("store_id", month_of(F.col("wk_end_date")).alias("month"))
        .agg(exact_sum("total_cost").alias("total_cost"), exact_sum("associate_hours_impact").alias("associate_hours"))
    )
    monthly = materialize(monthly, "store-months")
    stores = monthly.groupBy("store_id").agg(exact_sum("total_cost").alias("total_cost"))
    top = stores.orderBy(F.desc("total_cost"), "store_id").limit(n_stores)
    return monthly.join(top.select("store_id"), "store_id", "left_semi")


def dept_risk_matrix(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("dept_cat").isNotNull()).groupBy("dept_cat").agg(
        exact_mean("risk_score", RISK_SCALE).alias("mean_risk"),
        exact_mean("total_cost").alias("mean_cost"),
        F.count("*").alias("relay_count"),
    )


def dept_summary(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("dept_cat").isNotNull()).groupBy("dept_cat").agg(
        half_up(exact_sum("total_cost"), 2).alias("total_cost"),
        exact_mean("total_cost", digits=2).alias("mean_cost"),
        exact_mean("risk_score", RISK_SCALE, digits=2).alias("mean_risk"),
        F.count("*").alias("relay_count"),
    )


def kpi_metrics(scored: DataFrame, params: Params) -> DataFrame:
    """Global KPIs; savings at the standing rate, ROI and payback against the investment."""
    base = scored.agg(
        F.count("*").alias("total_relays"),
        exact_sum("total_cost").alias("total_cost"),
        exact_mean("total_cost", digits=2).alias("mean_cost"),
        F.count(F.when(F.col("risk_score") > params.high_risk, 1)).alias("high_risk_count"),
        F.count_distinct("wk_end_date").alias("weeks"),
    )
    savings = half_up(F.col("total_cost") * params.savings_rate, 2)
    weekly = F.col("potential_savings") / F.nullif("weeks", F.lit(0))
    return (
        base.withColumn("potential_savings", savings)
        .withColumn("roi_pct", half_up(weekly * 52 * 100 / params.investment, 2))
        .withColumn("payback_weeks", F.when(weekly > 0, half_up(params.investment / weekly, 4)))
        .drop("weeks")
    )


def plan_kpis(scored: DataFrame, benefit: DataFrame, params: Params) -> DataFrame:
    """Global KPIs with the savings, return and payback of the plan: the same figures as its timeline."""
    base = scored.agg(
        F.count("*").alias("total_relays"),
        exact_sum("total_cost").alias("total_cost"),
        exact_mean("total_cost", digits=2).alias("mean_cost"),
        F.count(F.when(F.col("risk_score") > params.high_risk, 1)).alias("high_risk_count"),
    )
    return base.withColumns({c: benefit.select(c).scalar() for c in ("annual_savings", "roi_pct", "payback_weeks")})


def top_risk(scored: DataFrame, n: int = 10) -> DataFrame:
    return (
        scored.select("relay_id", "store_id", "wk_end_date", "dept_cat", "risk_score", "total_cost")
        .orderBy(F.desc_nulls_last("risk_score"), "relay_id", "store_id", "wk_end_date")
        .limit(n)
    )


def high_frequency_stores(scored: DataFrame, params: Params) -> DataFrame:
    """Stores whose mean number of prior moves is above the limit."""
    return (
        scored.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(exact_mean("historical_moves_count", 0).alias("mean_prior_moves"), F.count("*").alias("relay_count"))
        .filter(F.col("mean_prior_moves") > params.frequent_moves)
    )


def dept_imbalance(scored: DataFrame, params: Params) -> DataFrame:
    """Whether row counts differ much between departments: sample deviation against the mean."""
    counts = scored.filter(F.col("dept_cat").isNotNull()).groupBy("dept_cat").agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("departments"),
        half_up(F.avg("n"), 4).alias("mean_count"),
        half_up(F.stddev_samp("n"), 4).alias("std_count"),
    ).withColumn(
        "is_uneven", F.coalesce(F.col("std_count") > F.col("mean_count") * params.imbalance_ratio, F.lit(False))
    )


def currency_label(scored: DataFrame) -> DataFrame:
    """Store costs with their short money label."""
    return store_performance(scored).select("store_id", "total_cost", money_label(F.col("total_cost")).alias("label"))


def cost_analysis(scored: DataFrame, params: Params) -> DataFrame:
    """Baseline, optimised cost at the standing savings rate, savings and their return."""
    total = F.col("baseline_cost")
    return (
        scored.agg(exact_sum("total_cost").alias("baseline_cost"))
        .withColumns(
            {
                "optimized_cost": half_up(total * (1 - params.savings_rate), 2),
                "savings": half_up(total * params.savings_rate, 2),
            }
        )
        .withColumn("roi_pct", percent(F.col("savings"), total))
    )


def predictive_insights(scored: DataFrame, params: Params) -> DataFrame:
    return scored.agg(
        F.count(F.when(F.col("risk_score") > params.high_risk, 1)).alias("high_risk_count"),
        exact_sum("total_cost").alias("cost_forecast"),
    ).withColumn("savings_potential", half_up(F.col("cost_forecast") * params.potential_rate, 2))


BUSY = "%d stores move their relays more often than the limit."
SEASONAL = "%d relays are seasonal and can be planned together."
UNEVEN = "Work is spread unevenly over %d departments."


def opportunities(scored: DataFrame, params: Params) -> DataFrame:
    """Up to three recommendations: busy stores, seasonal work, uneven departments."""

    def line(rows: DataFrame, title: str, description: str, n, impact: str, savings, effort: str) -> DataFrame:
        return rows.select(
            F.lit(title).alias("title"),
            F.format_string(description, n).alias("description"),
            F.lit(impact).alias("impact"),
            savings.cast("double").alias("estimated_savings"),
            F.lit(effort).alias("effort"),
        )

    # fixed values: savings per store and per seasonal relay, and for balancing departments
    busy = high_frequency_stores(scored, params).agg(F.count("*").alias("n")).filter("n > 0")
    seasonal = scored.agg(
        F.count(F.when(F.col("request_reason") == params.seasonal_reason, 1)).alias("n")
    ).filter(F.col("n") > params.seasonal_limit)
    uneven = dept_imbalance(scored, params).filter("is_uneven")
    return (
        line(busy, "Consolidate high-frequency stores", BUSY, F.col("n"), "High", F.col("n") * 5000, "Medium")
        .unionByName(line(seasonal, "Plan seasonal work ahead", SEASONAL, F.col("n"), "Medium", F.col("n") * 200, "Low"))
        .unionByName(line(uneven, "Balance departments", UNEVEN, F.col("departments"), "Medium", F.lit(15000), "Medium"))
    )


def dashboard_document(
    scored: DataFrame, requests: DataFrame, benefit: DataFrame, weekly: DataFrame, as_of, params: Params, top_n: int = 10
) -> DataFrame:
    """One JSON document: time stamp, summary, cost-benefit, KPIs, departments, riskiest relays and monthly trend.

    The parts are small before they are gathered: one row, one row per
    department or month, and `top_n` rows. Amounts are decimal text.
    """

    def text(col: str, kind: str = "decimal(20,2)"):
        return F.col(col).cast(kind).cast("string").alias(col)

    def one(row: DataFrame, *fields) -> DataFrame:
        return row.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))

    def many(rows: DataFrame, order: list, *fields) -> DataFrame:
        listed = rows.select(F.struct(*order).alias("o"), F.struct(*fields).alias("r"))
        listed = listed.agg(F.array_sort(F.collect_list(F.struct("o", "r"))).alias("l"))
        return listed.select(F.to_json(F.transform("l", lambda x: x["r"]), {"ignoreNullFields": "false"}))

    kpis = plan_kpis(scored, benefit, params)
    parts = {
        "executive_summary": one(
            exec_summary(scored, requests, params), "total_relays", text("total_cost"), "high_risk_count", "pending_requests"
        ),
        "cost_benefit": one(
            benefit,
            *[text(c) for c in ("baseline_cost", "optimized_cost", "savings", "weekly_savings", "annual_savings", "roi_pct")],
            text("payback_weeks", "decimal(20,4)"),
        ),
        "kpi_metrics": one(
            kpis,
            "total_relays",
            *[text(c) for c in ("total_cost", "mean_cost")],
            "high_risk_count",
            *[text(c) for c in ("annual_savings", "roi_pct")],
            text("payback_weeks", "decimal(20,4)"),
        ),
        "department_summary": many(
            dept_summary(scored), ["dept_cat"], "dept_cat", text("total_cost"), text("mean_risk"), "relay_count"
        ),
        "top_risk_relays": many(
            top_risk(scored, top_n),
            [(-F.col("risk_score")).alias("o"), "relay_id", "store_id", "wk_end_date"],
            "relay_id",
            "store_id",
            text("risk_score", "decimal(10,4)"),
            text("total_cost"),
            "dept_cat",
        ),
        "trends": many(kpi_trend(weekly), ["month"], "month", text("total_cost"), text("trend_pct"), "direction"),
    }
    document = [F.lit('{"data_timestamp":"'), F.date_format(as_of, "yyyy-MM-dd"), F.lit('"')]
    for name, part in parts.items():
        document += [F.lit(f',"{name}":'), part.scalar()]
    return benefit.select(F.concat(*document, F.lit("}")).alias("document"))
