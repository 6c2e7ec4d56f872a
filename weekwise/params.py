"""Tunable parameters of the engine."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Every constant an operator uses, with its default."""

    # -- fixed values: weekly caps and penalties of the planning model --
    total_cap: float = 1_000_000.0
    total_cap_holiday: float = 900_000.0
    nm_cap_per_store: float = 100.0
    nm_cap_per_store_holiday: float = 90.0
    nm_stores_per_week: int = 20
    over_penalty: float = 10.0
    nm_over_penalty: float = 10.0
    move_cost: float = 0.1
    lookback_days: int = 365
    horizon_weeks: int = 12

    # -- fixed values: change and group thresholds --
    change_threshold: float = 0.5
    group_count_threshold: int = 2

    # -- fixed values: cost, risk and savings model --
    labour_rate: float = 15.0
    setup_rate: float = 25.0
    default_associate_hours: float = 8.0
    default_relay_hours: float = 20.0
    high_risk: float = 7.0
    medium_risk: float = 4.0
    forecast_high: float = 50_000.0
    forecast_medium: float = 30_000.0
    savings_rate: float = 0.30
    potential_rate: float = 0.25
    investment: float = 50_000.0
    card_impact: int = 2_500
    frequent_moves: float = 3.0
    seasonal_limit: int = 10
    imbalance_ratio: float = 0.5

    # -- fixed values: data-quality targets --
    completeness_target: float = 95.0
    freshness_hours: float = 2.0

    # -- labels that drive flags and filters, as the adapters write them --
    seasonal_label: str = "Seasonal"
    realign_label: str = "Realignment"
    seasonal_reason: str = "REASON_0"
    pending_label: str = "Pending"
    approved_label: str = "Approved"
    high_priorities: tuple[str, ...] = ("High", "Urgent")
    nm_store_types: tuple[str, ...] = ("Neighborhood",)

    # "Now" is explicit, so that a rerun gives the same result. None means
    # the latest week of the work table.
    as_of: dt.date | None = None

    # -- scale knobs: they change the plan, never the result --
    prefix_hex_digits: int = 2
    percentile_fanout: int = 4096
    copy_chunk: int = 100_000
