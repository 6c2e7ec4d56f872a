"""Trends, forecasts, savings projections and what-if scenarios, mostly on week-grain frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import exact_sum, half_up, month_of, percent
from weekwise.functions.ordered import exact_percentile
from weekwise.params import Params


def weekly_cost(scored: DataFrame) -> DataFrame:
    return (
        scored.filter(F.col("wk_end_date").isNotNull())
        .groupBy("wk_end_date")
        .agg(exact_sum("total_cost").alias("total_cost"), exact_sum("relay_hours").alias("relay_hours"))
    )


def peak_weeks(weekly: DataFrame, value: str = "relay_hours") -> DataFrame:
    """Weeks more than one sample standard deviation above the mean week."""
    limit = weekly.agg(half_up(F.avg(value) + F.stddev_samp(value), 4)).scalar()
    return weekly.filter(F.col(value) > limit).select("wk_end_date", value)


def weekly_forecast(weekly: DataFrame, bounds: DataFrame, params: Params, trailing: int = 8, ahead: int = 12) -> DataFrame:
    """Mean of the trailing weeks carried forward along their linear trend.

    Hours, activity count and risk level follow from the cost.
    """
    last = bounds.select("last_week").scalar()
    at = (trailing - 1 - F.datediff(last, F.col("wk_end_date")) / 7).cast("int")
    x, y = F.col("at"), F.col("total_cost")
    # Least squares from exact sums, so the line does not depend on row order.
    sums = (
        weekly.withColumn("at", at)
        .filter((x >= 0) & (x < trailing))
        .agg(
            F.count("*").cast("double").alias("n"),
            F.sum(x).cast("double").alias("sx"),
            F.sum(x * x).cast("double").alias("sxx"),
            exact_sum(y).alias("sy"),
            exact_sum(x * y).alias("sxy"),
        )
    )
    n, sx, sxx, sy, sxy = (F.col(c) for c in ("n", "sx", "sxx", "sy", "sxy"))
    fit = sums.select(
        (sy / F.nullif(n, F.lit(0.0))).alias("level"),
        F.coalesce((n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0)), F.lit(0.0)).alias("slope"),
        (sx / F.nullif(n, F.lit(0.0))).alias("centre"),
    )
    weeks = bounds.select("last_week", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"))
    level, slope, centre = (fit.select(c).scalar() for c in ("level", "slope", "centre"))
    cost = half_up(F.greatest(F.lit(0.0), level + slope * (F.lit(trailing - 1) + F.col("step") - centre)), 2)
    return weeks.select(F.date_add("last_week", F.col("step") * 7).alias("wk_end_date"), cost.alias("forecast_cost")).select(
        "wk_end_date",
        "forecast_cost",
        half_up(F.col("forecast_cost") / params.setup_rate, 2).alias("forecast_hours"),
        F.floor(F.col("forecast_cost") / 1000).cast("bigint").alias("forecast_count"),
        F.when(F.col("forecast_cost") > params.forecast_high, "High")
        .when(F.col("forecast_cost") > params.forecast_medium, "Medium")
        .otherwise("Low")
        .alias("risk_level"),
    )


def kpi_trend(weekly: DataFrame) -> DataFrame:
    """Monthly cost, change on the month before in percent, and its direction.

    One row per month, so the window over all of them is bounded.
    """
    monthly = weekly.groupBy(month_of(F.col("wk_end_date")).alias("month")).agg(
        exact_sum("total_cost").alias("total_cost")
    )
    before = F.lag("total_cost").over(Window.orderBy("month"))
    change = F.coalesce(percent(F.col("total_cost") - F.col("prior_cost"), F.col("prior_cost")), F.lit(0.0))
    return (
        monthly.withColumn("prior_cost", before)
        .withColumn("trend_pct", change)
        .withColumn(
            "direction", F.when(F.col("trend_pct") > 0, "up").when(F.col("trend_pct") < 0, "down").otherwise("flat")
        )
        .select("month", "total_cost", "trend_pct", "direction")
    )


def cost_benefit(baseline: DataFrame, optimized: DataFrame, weeks: DataFrame, params: Params) -> DataFrame:
    """One-row record from two schedule objectives: weekly and annual savings, payback, ROI."""
    n_weeks = F.nullif(weeks.agg(F.count("*")).scalar(), F.lit(0))
    return (
        baseline.select(F.col("objective").alias("baseline_cost"))
        .withColumn("optimized_cost", optimized.select("objective").scalar())
        .withColumn("savings", half_up(F.col("baseline_cost") - F.col("optimized_cost"), 2))
        .withColumn("weekly_savings", half_up(F.col("savings") / n_weeks, 2))
        .withColumn("annual_savings", half_up(F.col("weekly_savings") * 52, 2))
        .withColumn(
            "payback_weeks", F.when(F.col("weekly_savings") > 0, half_up(params.investment / F.col("weekly_savings"), 4))
        )
        .withColumn("roi_pct", half_up(F.col("annual_savings") * 100 / params.investment, 2))
    )


def cost_waterfall(benefit: DataFrame) -> DataFrame:
    """Steps from the baseline to the optimised cost: 40 %, 40 % and 20 % of the savings."""
    s = F.col("savings")
    steps = [
        (1, "Baseline", F.col("baseline_cost")),
        (2, "Overtime", half_up(s * -0.4, 2)),
        (3, "Balancing", half_up(s * -0.4, 2)),
        (4, "Compliance", half_up(s * -0.2, 2)),
        (5, "Optimized", F.col("optimized_cost")),
    ]
    return benefit.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("step"), a.alias("amount")) for i, n, a in steps])
        ).alias("r")
    ).select("r.*")


def roi_timeline(benefit: DataFrame, params: Params, weeks: int = 52) -> DataFrame:
    """Cumulative savings by week and the net of the investment."""
    return benefit.select("weekly_savings", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week_number")).select(
        "week_number",
        half_up(F.col("weekly_savings") * F.col("week_number"), 2).alias("cumulative_savings"),
        half_up(F.col("weekly_savings") * F.col("week_number") - params.investment, 2).alias("net_benefit"),
    )


def cost_roi(scored: DataFrame, requests: DataFrame) -> DataFrame:
    """Cost and return per relay: expected sales of its requests against the cost of its work.

    Both sides are added up per relay before they meet.
    """
    cost = scored.groupBy("relay_id").agg(exact_sum("total_cost").alias("relay_cost"))
    sales = requests.groupBy("relay_id").agg(exact_sum("expected_sales_impact").alias("expected_sales"))
    return cost.join(sales, "relay_id", "left").withColumn(
        "roi",
        half_up(
            (F.coalesce("expected_sales", F.lit(0.0)) - F.col("relay_cost")) / F.nullif("relay_cost", F.lit(0.0)), 4
        ),
    )


def cost_roi_quadrants(costs: DataFrame, params: Params) -> DataFrame:
    """Relays by return (above 0 or not) and cost (above the median or not)."""
    median = exact_percentile(costs, "relay_cost", 0.5, fanout=params.percentile_fanout)
    dear = F.col("relay_cost") > F.lit(median)
    gains = F.col("roi") > 0
    quadrant = (
        F.when(gains & ~dear, "Quick win")
        .when(gains & dear, "Strategic")
        .when(~gains & ~dear, "Low value")
        .otherwise("Reconsider")
    )
    return costs.groupBy(quadrant.alias("quadrant")).agg(
        F.count("*").alias("relay_count"), exact_sum("relay_cost").alias("total_cost")
    )


def what_if_thresholds(over: DataFrame, scenarios: dict[str, float], params: Params) -> DataFrame:
    """Weeks and hours over the total cap, and the penalty, if the cap were scaled.

    The scenarios are an array on each week-grain row, so no join is needed.
    """
    cases = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("scale")) for n, s in scenarios.items()])
    excess = F.greatest(F.lit(0.0), F.col("total_hours") - F.floor(F.col("total_cap") * F.col("c.scale")).cast("double"))
    return (
        over.select("total_hours", "total_cap", F.explode(cases).alias("c"))
        .select(F.col("c.scenario").alias("scenario"), excess.alias("excess"))
        .groupBy("scenario")
        .agg(F.count(F.when(F.col("excess") > 0, 1)).alias("weeks_over"), exact_sum("excess").alias("hours_over"))
        .withColumn("penalty", half_up(F.col("hours_over") * params.over_penalty, 2))
    )
