"""Small hand-made tables."""

import datetime as dt

from weekwise.sources.schemas import LOGICAL, Tables, week_bounds

W1, W2, W3, W4 = (dt.date(2024, 1, 7) + dt.timedelta(days=7 * i) for i in range(4))


def frame(spark, table, *rows, **defaults):
    """Rows given as dicts; columns left out take the default, or null."""
    names = [part.strip().split(" ")[0] for part in LOGICAL[table].split(",")]
    data = [tuple({**defaults, **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, LOGICAL[table])


def relays(spark, *rows):
    return frame(
        spark,
        "relays",
        *rows,
        dept_cat="A",
        relay_change_perc=0.6,
        total_store_hours=10.0,
        short_desc="Standard",
        relay_year=2024,
        request_reason="REASON_1",
        historical_moves_count=1,
        associate_hours_impact=3.0,
        material_cost=100.0,
        market_factor=1.0,
    )


def tables(spark, relay_rows, bridge_rows, request_rows=(), group_rows=(), holiday_rows=(), store_rows=()):
    r = relays(spark, *relay_rows)
    return Tables(
        relays=r,
        stores=frame(spark, "stores", *store_rows),
        bridge=frame(spark, "bridge", *bridge_rows, store_type="Large"),
        requests=frame(spark, "requests", *request_rows, request_type="Business", status="Pending"),
        groups=frame(spark, "groups", *group_rows, sync_required=True),
        holidays=frame(spark, "holidays", *holiday_rows, holiday_type="Standard", is_holiday=True),
        week_bounds=week_bounds(r),
    )
