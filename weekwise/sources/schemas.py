"""Schemas of the six logical tables, checked once at load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.functions.columns import clean_key

LOGICAL = {
    "relays": (
        "relay_id STRING, wk_end_date DATE, dept_cat STRING, relay_change_perc DOUBLE, total_store_hours DOUBLE, "
        "short_desc STRING, relay_year INT, request_reason STRING, historical_moves_count BIGINT, "
        "associate_hours_impact DOUBLE, material_cost DOUBLE, market_factor DOUBLE"
    ),
    "stores": "store_id BIGINT, store_type STRING, region STRING",
    "bridge": "relay_id STRING, wk_end_date DATE, store_id BIGINT, store_type STRING",
    "requests": (
        "request_id STRING, relay_id STRING, store_id BIGINT, request_type STRING, status STRING, "
        "requested_move_wk DATE, original_wk_end_date DATE, requested_by STRING, priority_level STRING, "
        "expected_sales_impact DOUBLE, cost_estimate DOUBLE, request_ts TIMESTAMP_NTZ"
    ),
    "groups": "adjustment_group_id STRING, relay_id STRING, sync_required BOOLEAN",
    "holidays": "wk_end_date DATE, holiday_name STRING, holiday_type STRING, is_holiday BOOLEAN",
}


@dataclass(frozen=True)
class Tables:
    """The six logical tables, and the one-row (first_week, last_week) frame of the work table."""

    relays: DataFrame
    stores: DataFrame
    bridge: DataFrame
    requests: DataFrame
    groups: DataFrame
    holidays: DataFrame
    week_bounds: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in LOGICAL}


def fields(ddl: str) -> dict[str, str]:
    return dict(part.strip().split(" ", 1) for part in ddl.split(","))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Check required columns and types of a logical table and put them in order.

    A missing column raises: an empty stand-in would hide the fault.
    """
    wanted = fields(LOGICAL[table])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"table {table} lacks columns {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in wanted.items()])


def clean_keys(df: DataFrame) -> DataFrame:
    """Join keys as trimmed text, done once at load: a key that changed after a
    shuffle would have to be shuffled again."""
    return df.withColumns({c: clean_key(F.col(c)) for c in ("relay_id", "adjustment_group_id") if c in df.columns})


def week_bounds(relays: DataFrame) -> DataFrame:
    """First and last week of a work table, one row."""
    return relays.agg(F.min("wk_end_date").alias("first_week"), F.max("wk_end_date").alias("last_week"))
