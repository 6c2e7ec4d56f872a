"""Aggregates over the request table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.functions.columns import exact_mean, exact_sum, percent
from weekwise.params import Params


def request_frequency(requests: DataFrame) -> DataFrame:
    return (
        requests.filter(F.col("requested_by").isNotNull())
        .groupBy("requested_by")
        .agg(F.count("*").alias("request_count"))
    )


def _with_share(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("share_pct", percent(F.col("row_count"), total, 4))


def status_breakdown(df: DataFrame) -> DataFrame:
    """Rows and share per status; null statuses are left out."""
    return _with_share(
        df.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("row_count"))
    )


def master_status(placed: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """Status shares over the full chain, from counts per relay instead of the fanned-out rows."""
    rows = placed.groupBy("relay_id").agg(F.count("*").alias("placed"))
    per_group = groups.groupBy("relay_id").agg(F.count("*").alias("n_groups"))
    per_status = requests.groupBy("relay_id", F.coalesce("status", F.lit("None")).alias("status")).agg(
        F.count("*").alias("n_requests")
    )
    joined = rows.join(per_group, "relay_id", "left").join(per_status, "relay_id", "left")
    copies = F.col("placed") * F.coalesce("n_groups", F.lit(1)) * F.coalesce("n_requests", F.lit(1))
    return _with_share(
        joined.groupBy(F.coalesce("status", F.lit("None")).alias("status")).agg(F.sum(copies).alias("row_count"))
    )


def request_seasonality(requests: DataFrame) -> DataFrame:
    """Requests by the month in which they were made."""
    return (
        requests.filter(F.col("request_ts").isNotNull())
        .groupBy(F.month("request_ts").alias("month"))
        .agg(F.count("*").alias("request_count"))
    )


def pending_requests(requests: DataFrame, params: Params) -> DataFrame:
    """Open requests, as listed when no move has been suggested."""
    return requests.filter(F.col("status") == params.pending_label).select(
        "request_id", "relay_id", "store_id", "request_type", "requested_move_wk", "original_wk_end_date", "priority_level"
    )


def merchant_scorecard(requests: DataFrame, params: Params) -> DataFrame:
    """Per requester: requests, approval and high-priority rates, expected sales."""
    approved = F.count(F.when(F.col("status") == params.approved_label, 1))
    high = F.count(F.when(F.col("priority_level").isin(*params.high_priorities), 1))
    return (
        requests.filter(F.col("requested_by").isNotNull())
        .groupBy("requested_by")
        .agg(
            F.count("*").alias("request_count"),
            percent(approved, F.count("*")).alias("approval_rate"),
            percent(high, F.count("*")).alias("high_priority_rate"),
            exact_sum("expected_sales_impact").alias("expected_sales"),
            exact_mean("expected_sales_impact", digits=2).alias("mean_expected_sales"),
        )
    )


def seasonal_patterns(requests: DataFrame) -> DataFrame:
    return (
        requests.filter(F.col("request_type").isNotNull() & F.col("request_ts").isNotNull())
        .groupBy(F.month("request_ts").alias("month"), "request_type")
        .agg(F.count("*").alias("request_count"))
    )


def request_status_cards(requests: DataFrame, params: Params) -> DataFrame:
    """Counts by (type, status) added up by status, with the standing impact per request."""
    by_type = (
        requests.filter(F.col("status").isNotNull())
        .groupBy("request_type", "status")
        .agg(F.count("*").alias("n"))
    )
    return (
        by_type.groupBy("status")
        .agg(F.sum("n").alias("request_count"))
        .withColumn("impact", F.col("request_count") * params.card_impact)
    )
