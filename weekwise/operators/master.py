"""The denormalised work schedule: flags, joins and instances.

Grain after the first join is relay x store x week. Adjustment groups and
requests then fan it out. Operators that only need counts over the fanned-out
table multiply pre-aggregated counts instead of building it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import column_or, half_up, instance_key
from weekwise.functions.skew import hot_keys, split_left_join
from weekwise.operators.calendar import as_of_date, holiday_weeks
from weekwise.params import Params
from weekwise.session import materialize
from weekwise.sources.schemas import Tables

INSTANCE = ["relay_id", "store_id", "original_wk_end_date"]


def relay_flags(relays: DataFrame, params: Params) -> DataFrame:
    """Seasonal, realignment and cannot-move flags; year from the week where it is missing."""
    year = F.year("wk_end_date")
    return (
        relays.withColumn(
            "relay_year", F.coalesce("relay_year", year) if "relay_year" in relays.columns else year
        )
        .withColumns(
            {
                "is_seasonal": F.coalesce(F.col("short_desc") == params.seasonal_label, F.lit(False)),
                "is_dc_realign": F.coalesce(F.col("short_desc") == params.realign_label, F.lit(False)),
            }
        )
        .withColumn("cannot_move", F.col("is_seasonal") | F.col("is_dc_realign"))
    )


def with_hours(relays: DataFrame, column: str = "total_store_hours") -> DataFrame:
    """`relay_hours` from the configured column; a missing column raises."""
    if column not in relays.columns:
        raise ValueError(f"hours column {column} is missing")
    return relays.withColumn("relay_hours", F.col(column).cast("double"))


def relay_store_join(relays: DataFrame, bridge: DataFrame, params: Params) -> DataFrame:
    """Relays with their stores: inner join on (relay, week)."""
    left = relay_flags(with_hours(relays), params)
    right = bridge.select(
        "relay_id",
        "wk_end_date",
        "store_id",
        F.coalesce("store_type", F.lit("Unknown")).alias("store_type"),
    )
    return left.join(right, ["relay_id", "wk_end_date"]).withColumn("original_wk_end_date", F.col("wk_end_date"))


def holiday_flags(placed: DataFrame, holidays: DataFrame) -> DataFrame:
    """Add `is_holiday` and `holiday_name` from one row per week."""
    return placed.join(holiday_weeks(holidays), "wk_end_date", "left").withColumns(
        {
            "is_holiday": F.coalesce("is_holiday", F.lit(False)),
            "holiday_name": F.coalesce("holiday_name", F.lit("None")),
        }
    )


def group_join(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Add adjustment groups; a relay in two groups gives two rows."""
    return placed.join(groups.select("relay_id", "adjustment_group_id"), "relay_id", "left").withColumn("adjustment_group_id", F.coalesce("adjustment_group_id", F.lit("NO_GROUP")))


def request_join(placed: DataFrame, requests: DataFrame, hot: dict | None = None) -> DataFrame:
    """Add requests by relay (not store): one row per request of the relay.

    With `hot` from `hot_keys(requests, "relay_id")` the requests of those
    relays are dealt to several tasks; a left join cannot be split there at run time.
    """
    salt = ["request_id"] if hot else []
    right = requests.select("relay_id", "request_type", "requested_move_wk", "status", *salt)
    return split_left_join(placed, right, "relay_id", salt, hot or {}).withColumns(
        {
            "request_type": F.coalesce("request_type", F.lit("None")),
            "status": F.coalesce("status", F.lit("None")),
        }
    )


def master_schedule(tables: Tables, params: Params) -> DataFrame:
    """The whole chain: stores, holidays, groups, requests."""
    placed = relay_store_join(tables.relays, tables.bridge, params)
    grouped = group_join(holiday_flags(placed, tables.holidays), tables.groups)
    return request_join(grouped, tables.requests, hot_keys(tables.requests, "relay_id"))


def fan_out(placed: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """Add `copies`: how many rows of the full chain each placed row becomes.

    The join is against one count per relay, so no row is multiplied.
    """
    per_group = groups.groupBy("relay_id").agg(F.count("*").alias("n_groups"))
    per_request = requests.groupBy("relay_id").agg(F.count("*").alias("n_requests"))
    return (
        placed.join(per_group, "relay_id", "left")
        .join(per_request, "relay_id", "left")
        .withColumn(
            "copies", F.coalesce("n_groups", F.lit(1)) * F.coalesce("n_requests", F.lit(1))
        )
        .drop("n_groups", "n_requests")
    )


def _best_first(df: DataFrame) -> list:
    """Latest requested week, latest week, largest change, most hours; ties by label."""
    ties = [c for c in ("adjustment_group_id", "request_type", "status") if c in df.columns]
    down = [c for c in ("requested_move_wk", "wk_end_date", "relay_change_perc", "relay_hours") if c in df.columns]
    return [F.desc_nulls_last(c) for c in down] + [F.asc_nulls_last(c) for c in ties]


def dedupe_instances(master: DataFrame) -> DataFrame:
    """Best row per (relay, store, week).

    The rank filter is pushed below the shuffle as a group limit, so each map
    task sends one row per instance however many copies it holds.
    """
    pick = Window.partitionBy(*INSTANCE).orderBy(*_best_first(master))
    return master.withColumn("rn", F.row_number().over(pick)).filter("rn = 1").drop("rn")


def best_request(requests: DataFrame) -> DataFrame:
    """The request a relay keeps after deduplication, one row per relay."""
    rows = requests.select("relay_id", "request_type", "requested_move_wk", "status")
    pick = Window.partitionBy("relay_id").orderBy(*_best_first(rows))
    return rows.withColumn("rn", F.row_number().over(pick)).filter("rn = 1").drop("rn")


def first_group(groups: DataFrame) -> DataFrame:
    """The group a relay keeps after deduplication, one row per relay."""
    return groups.groupBy("relay_id").agg(F.min("adjustment_group_id").alias("adjustment_group_id"))


def instances(tables: Tables, params: Params, unique_keys: bool = False, placed: DataFrame | None = None) -> DataFrame:
    """Deduplicated schedule: same rows as `dedupe_instances(master_schedule(..))`.

    Groups and requests are cut to one row per relay before the joins, so the
    fan-out is never built. A last pass drops repeated relay rows, unless
    `unique_keys` says that relays are unique by (relay, week) and the bridge
    by (relay, week, store). `placed` are the rows of `relay_store_join`,
    where they are stored already.
    """
    if placed is None:
        placed = relay_store_join(tables.relays, tables.bridge, params)
    rows = request_join(
        group_join(holiday_flags(placed, tables.holidays), first_group(tables.groups)), best_request(tables.requests)
    )
    return rows if unique_keys else dedupe_instances(rows)


def with_instance_key(df: DataFrame) -> DataFrame:
    return df.withColumn("instance_key", instance_key())


def optim_scope(placed: DataFrame, bounds: DataFrame, params: Params) -> DataFrame:
    """Rows whose original week is within the lookback before `as_of`."""
    return placed.filter(
        F.col("original_wk_end_date") >= F.date_sub(as_of_date(bounds, params), params.lookback_days)
    )


def _row_text(names: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])


def key_suffix(keyed: DataFrame, params: Params) -> DataFrame:
    """Number the rows of each instance key from 0 and append the number from 1 on.

    The order is md5 of the row, then the row. Rows are numbered where the
    rows of their key meet, after one shuffle that carries the rows alone.
    Keys with more rows than a task should hold, found by a sketch, are
    numbered in buckets. The rows are stored: both passes read them.
    """
    keyed = materialize(keyed, "keyed")
    conf = keyed.sparkSession.conf
    parts = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    hot = list(hot_keys(keyed, "instance_key", parts=parts and int(parts)))
    is_hot = F.col("instance_key").isin(hot)
    counted = _counted_together(keyed.filter(~is_hot if hot else F.col("instance_key").isNotNull()))
    if hot:
        counted = counted.unionByName(_counted_in_buckets(keyed.filter(is_hot), params))
    return counted.withColumn(
        "unique_key",
        F.when(F.col("counter") == 0, F.col("instance_key")).otherwise(
            F.concat_ws("_", "instance_key", F.col("counter").cast("string"))
        ),
    )


def _counted_together(keyed: DataFrame) -> DataFrame:
    """`counter` of each row among the rows of its key; md5 and text are made after the shuffle."""
    names = keyed.columns
    met = keyed.repartition("instance_key").withColumn("row_text", _row_text(names))
    met = met.withColumn("h", F.md5(F.col("row_text").cast("binary")))
    along = Window.partitionBy("instance_key").orderBy("h", "row_text", *names)
    return met.select(*names, (F.row_number().over(along) - 1).cast("bigint").alias("counter"))


def _counted_in_buckets(keyed: DataFrame, params: Params) -> DataFrame:
    """The same for keys with very many rows, which are spread over many tasks.

    Equal rows are counted first and expanded last, and the running counter
    is split by hash prefix.
    """
    names = keyed.columns
    counted = keyed.groupBy(*names).agg(F.count("*").alias("n"))
    tagged = counted.withColumn("row_text", _row_text(names)).withColumns({"h": F.md5(F.col("row_text").cast("binary"))})
    tagged = tagged.withColumn("hx", F.substring("h", 1, params.prefix_hex_digits))

    along = Window.partitionBy("instance_key").orderBy("hx").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy("instance_key", "hx")
        .agg(F.sum("n").alias("in_bucket"))
        .withColumn("start", F.coalesce(F.sum("in_bucket").over(along), F.lit(0)))
        .drop("in_bucket")
    )
    inside = Window.partitionBy("instance_key", "hx").orderBy("h", "row_text").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = tagged.join(starts, ["instance_key", "hx"]).withColumn(
        "first", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )
    # Very many copies of one row leave in chunks that other tasks expand.
    chunks = first.select(
        *names,
        "first",
        "n",
        F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(params.copy_chunk))).alias("at"),
    ).repartition(*names, "at")
    return chunks.select(
        *names,
        F.explode(
            F.sequence(
                F.col("first") + F.col("at"),
                F.col("first") + F.least(F.col("at") + params.copy_chunk, F.col("n")) - 1,
            )
        ).alias("counter"),
    )


def duplicate_keys(keyed: DataFrame) -> DataFrame:
    """Instance keys that occur more than once; empty means the key is unique."""
    return keyed.groupBy("instance_key").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


# -- cost and risk --------------------------------------------------------


def move_cost(df: DataFrame, params: Params) -> DataFrame:
    """Direct labour, setup, material and total cost of a row."""
    hours = column_or(df, "associate_hours_impact", params.default_associate_hours)
    setup = column_or(df, "relay_hours", params.default_relay_hours)
    material = column_or(df, "material_cost", 0.0)
    return df.withColumns(
        {
            "labour_cost": half_up(hours * params.labour_rate, 2),
            "setup_cost": half_up(setup * params.setup_rate, 2),
            "material_cost": material,
        }
    ).withColumn("total_cost", half_up(F.col("labour_cost") + F.col("setup_cost") + F.col("material_cost"), 2))


def top_cost(costed: DataFrame) -> DataFrame:
    """The largest cost, one row."""
    return costed.agg(F.max("total_cost").alias("top"))


def risk_score(costed: DataFrame, params: Params, top: DataFrame | None = None) -> DataFrame:
    """Hours, market and relative-cost risk; the largest cost is a scalar subquery, of `top` where it is stored already."""
    top = (top_cost(costed) if top is None else top).scalar()
    hours = column_or(costed, "associate_hours_impact", params.default_associate_hours)
    return costed.withColumn(
        "risk_score",
        half_up(
            hours * 3.0 / 16.0
            + column_or(costed, "market_factor", 1.0)
            + F.when(top == 0, F.lit(0.0)).otherwise(F.col("total_cost") * 3.0 / top),
            4,
        ),
    ).withColumn("risk_category", risk_category(params))


def risk_category(params: Params, score: str = "risk_score"):
    return (
        F.when(F.col(score) > params.high_risk, "High").when(F.col(score) > params.medium_risk, "Medium").otherwise("Low")
    )


def costed_relays(relays: DataFrame, params: Params) -> DataFrame:
    return move_cost(with_hours(relays), params)


def scored_relays(relays: DataFrame, params: Params, top: DataFrame | None = None) -> DataFrame:
    return risk_score(costed_relays(relays, params), params, top)


def scored_schedule(tables: Tables, params: Params, top: DataFrame | None = None) -> DataFrame:
    """Placed rows with cost and risk, computed once per relay week before the join."""
    return relay_store_join(scored_relays(tables.relays, params, top), tables.bridge, params)
