"""Data-quality operators: completeness, volume, distribution, freshness, keys, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwise.functions.columns import equal_width_bin, half_up, month_of, percent
from weekwise.operators.calendar import as_of_date
from weekwise.params import Params
from weekwise.sources.schemas import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def completeness(df: DataFrame, table: str, params: Params) -> DataFrame:
    """Percent of non-null values per column, all columns in one pass."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
    return (
        counts.unpivot("__rows", df.columns, "column_name", "filled")
        .select(F.lit(table).alias("table_name"), "column_name", percent(F.col("filled"), F.col("__rows")).alias("completeness_pct"))
        .withColumn("below_target", F.col("completeness_pct") < params.completeness_target)
    )


def dq_completeness(frames: dict[str, DataFrame], params: Params) -> DataFrame:
    return _union([completeness(df, name, params) for name, df in frames.items()])


def dated_column(df: DataFrame) -> str | None:
    """First column whose name contains date or timestamp."""
    return next((c for c in df.columns if "date" in c.lower() or "timestamp" in c.lower()), None)


def dq_volume(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per month on each table's first dated column; tables without one are left out."""
    parts = []
    for name, df in frames.items():
        column = dated_column(df)
        if column:
            parts.append(
                df.filter(F.col(column).isNotNull())
                .groupBy(month_of(F.col(column)).alias("month"))
                .agg(F.count("*").alias("row_count"))
                .select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "month", "row_count")
            )
    return _union(parts)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def dq_histograms(tables: dict[str, DataFrame], bins: int = 20) -> DataFrame:
    """Histograms of every numeric column of every table."""
    return _union(
        [
            dq_histogram(df, bins=bins).select(F.lit(name).alias("table_name"), "column_name", "bin", "row_count")
            for name, df in tables.items()
            if numeric_columns(df)
        ]
    )


def dq_histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width histogram of the given columns, by default all numeric ones.

    The edges of all columns come from one aggregation, joined back as one
    row per column; the values are binned in one pass over the long form.
    """
    names = columns or numeric_columns(df)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    long = wide.unpivot([], names, "column_name", "value").filter(F.col("value").isNotNull())
    edges = wide.agg(
        *[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names]
    ).select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in names])
        ).alias("e")
    ).select("e.*")
    return (
        long.join(edges, "column_name")
        .groupBy("column_name", equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("row_count"))
    )


def risk_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width histogram of the risk score by category."""
    low = scored.agg(F.min("risk_score")).scalar()
    high = scored.agg(F.max("risk_score")).scalar()
    return (
        scored.filter(F.col("risk_score").isNotNull())
        .groupBy("risk_category", equal_width_bin(F.col("risk_score"), low, high, bins).alias("bin"))
        .agg(F.count("*").alias("row_count"))
    )


def dq_freshness(stamped: dict[str, tuple[DataFrame, str]], bounds: DataFrame, params: Params) -> DataFrame:
    """Hours between `as_of` and the newest row of each table, and whether that is within target."""
    as_of = as_of_date(bounds, params).cast("timestamp")
    parts = [
        df.agg(F.max(F.col(column)).cast("timestamp").alias("newest")).select(F.lit(name).alias("table_name"), "newest")
        for name, (df, column) in stamped.items()
    ]
    lag = half_up((F.unix_timestamp(as_of) - F.unix_timestamp("newest")) / 3600.0, 2)
    return (
        _union(parts)
        .withColumn("lag_hours", lag)
        .select("table_name", "lag_hours", (F.col("lag_hours") <= params.freshness_hours).alias("is_fresh"))
    )


def orphan_rate(child: DataFrame, parent: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose key has no parent, over all rows with a key.

    The child is counted per key, once, before the join, so a hot key is one row.
    """
    per_key = child.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    known = parent.select(*keys, F.lit(1).alias("known")).distinct()
    counts = per_key.join(known, keys, "left").agg(
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
    )
    return counts.select(F.lit(name).alias("foreign_key"), "orphans", "total_rows").withColumn(
        "orphan_pct", percent(F.col("orphans"), F.col("total_rows"), 4)
    )


def dq_orphans(tables: Tables) -> DataFrame:
    return _union(
        [
            orphan_rate(tables.bridge, tables.relays, ["relay_id", "wk_end_date"], "bridge_relay_week"),
            orphan_rate(tables.bridge, tables.stores, ["store_id"], "bridge_store"),
            orphan_rate(tables.requests, tables.relays, ["relay_id"], "request_relay"),
            orphan_rate(
                tables.requests.withColumnRenamed("requested_move_wk", "wk_end_date"),
                tables.bridge,
                ["relay_id", "wk_end_date"],
                "request_target_week",
            ),
            orphan_rate(tables.groups, tables.relays, ["relay_id"], "group_relay"),
        ]
    )


def rule_rates(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Percent of rows that pass each rule, all rules in one pass; unknown counts as failing."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(F.when(r, 1)).alias(n) for n, r in rules.items()])
    return counts.unpivot("__rows", list(rules), "rule_name", "passed").select(
        F.lit(table).alias("table_name"),
        "rule_name",
        F.col("passed").alias("passed_rows"),
        percent(F.col("passed"), F.col("__rows"), 4).alias("pass_pct"),
    )


def dq_rules(tables: Tables, params: Params) -> DataFrame:
    c = F.col
    return _union(
        [
            rule_rates(
                tables.relays,
                "relays",
                {
                    "change_in_range": c("relay_change_perc").between(0, 1),
                    "hours_positive": c("total_store_hours") > 0,
                    "hours_below_nm_cap": c("total_store_hours") <= params.nm_cap_per_store,
                    "year_matches_week": c("relay_year") == F.year("wk_end_date"),
                    "week_is_sunday": F.dayofweek("wk_end_date") == 1,
                },
            ),
            rule_rates(
                tables.requests,
                "requests",
                {
                    "status_in_domain": c("status").isin("Approved", "Pending", "In Progress", "Rejected"),
                    "priority_in_domain": c("priority_level").isin("Urgent", "High", "Medium", "Low"),
                    "sales_cover_cost": c("expected_sales_impact") >= c("cost_estimate"),
                    "move_is_later": c("requested_move_wk") >= c("original_wk_end_date"),
                },
            ),
            rule_rates(tables.bridge, "bridge", {"store_known": c("store_id").isNotNull()}),
        ]
    )
