"""Derive the six logical tables from the star-schema parquet files.

Each table is read with a fixed schema, so no footer is opened to infer one
and only the columns used reach the scan. Relay keys are numbers as text and
need no trimming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwise.functions.columns import half_up, week_end
from weekwise.operators.calendar import holiday_calendar
from weekwise.sources.schemas import Tables, conform

RAW = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("relay_id"),
        week_end(F.col("l_shipdate")).alias("wk_end_date"),
        F.col("l_suppkey").alias("store_id"),
        "l_quantity",
        "l_discount",
    )


def relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = (
        _placements(spark, sf_dir)
        .groupBy("relay_id", "wk_end_date")
        .agg(
            half_up(F.max("l_discount") * 10, 2).alias("relay_change_perc"),
            F.sum("l_quantity").alias("total_store_hours"),
            F.count("*").alias("lines"),
        )
    )
    part = raw(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("relay_id"), "p_partkey", "p_type", "p_size", "p_retailprice"
    )
    kind = F.col("p_partkey") % 10
    return conform(
        work.join(part, "relay_id").select(
            "relay_id",
            "wk_end_date",
            F.col("p_type").alias("dept_cat"),
            "relay_change_perc",
            "total_store_hours",
            F.when(kind == 0, "Seasonal")
            .when(kind == 1, "Realignment")
            .otherwise("Standard")
            .alias("short_desc"),
            F.year("wk_end_date").alias("relay_year"),
            F.concat(F.lit("REASON_"), (F.col("p_size") % 9).cast("string")).alias("request_reason"),
            (F.col("lines") + F.col("p_size") % 5).alias("historical_moves_count"),
            half_up(2 + F.col("total_store_hours") * 0.1, 2).alias("associate_hours_impact"),
            half_up(100 + (F.col("p_retailprice") - 900) * 4, 2).alias("material_cost"),
            (1 + 3 * ((F.col("p_partkey") * 7919) % 1000) / F.lit(1000.0)).alias("market_factor"),
        ),
        "relays",
    )


def _store_type() -> Column:
    kind = (F.col("s_suppkey") * 7) % 20
    return (
        F.when(kind < 12, "Large").when(kind < 17, "Neighborhood").when(kind < 19, "Club").otherwise("Express")
    ).alias("store_type")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = raw(spark, sf_dir, "nation").join(
        raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return conform(
        raw(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("store_id"),
            _store_type(),
            F.col("r_name").alias("region"),
        ),
        "stores",
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct placements with their store type.

    They are told apart by number; the key becomes text on the rows that are left.
    The type comes from the supplier file alone, whose size Spark knows: it is
    broadcast while small and shuffled once it is not.
    """
    lines = raw(spark, sf_dir, "lineitem").select(
        "l_partkey", week_end(F.col("l_shipdate")).alias("wk_end_date"), F.col("l_suppkey").alias("store_id")
    )
    placed = lines.distinct().withColumn("relay_id", F.col("l_partkey").cast("string"))
    kinds = raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), _store_type())
    return conform(placed.join(kinds, "store_id", "left"), "bridge")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        raw(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("store_id"))
    )
    key = F.col("o_orderkey")
    shift = ((key % 16 - 4) * 7).cast("int")
    return conform(
        raw(spark, sf_dir, "orders")
        .join(lines, key == F.col("l_orderkey"))
        .join(raw(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.lit("REQ_"), key.cast("string")).alias("request_id"),
            F.col("part").cast("string").alias("relay_id"),
            "store_id",
            F.when(key % 5 < 3, "Business").otherwise("Merchant").alias("request_type"),
            F.when(F.col("o_orderstatus") == "F", "Approved")
            .when(F.col("o_orderstatus") == "O", "Pending")
            .when(key % 3 == 0, "In Progress")
            .otherwise("Rejected")
            .alias("status"),
            week_end(F.date_add(F.col("o_orderdate").cast("date"), shift)).alias("requested_move_wk"),
            week_end(F.col("o_orderdate")).alias("original_wk_end_date"),
            F.col("c_mktsegment").alias("requested_by"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Urgent")
            .when(F.col("o_orderpriority") == "2-HIGH", "High")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
            .otherwise("Low")
            .alias("priority_level"),
            F.col("o_totalprice").alias("expected_sales_impact"),
            half_up(F.col("o_totalprice") / 100, 2).alias("cost_estimate"),
            F.col("o_orderdate").alias("request_ts"),
        ),
        "requests",
    )


def request_deliveries(requests: DataFrame) -> DataFrame:
    """Requests as they reach a stream: `delivery` counts spans of two years.

    Every 17th request comes two deliveries late; of the others every tenth
    comes twice in its own delivery and once more in the next one.
    """
    key = F.substring_index("request_id", "_", -1).cast("long")
    span = F.floor(F.year("request_ts") / 2).cast("int")
    numbers = F.when(key % 17 == 0, F.array(span + 2)).when(key % 10 == 0, F.array(span, span, span + 1))
    return requests.withColumn("delivery", F.explode(F.coalesce(numbers, F.array(span))))


def request_text(requests: DataFrame) -> DataFrame:
    """Requests as a careless text export: keys with blanks around them, some dates with a time, some not given."""
    key = F.substring_index("request_id", "_", -1).cast("long")
    week = F.col("requested_move_wk").cast("string")
    text = requests.select(*[F.col(c).cast("string").alias(c) for c in requests.columns])
    return text.withColumns(
        {
            "relay_id": F.concat(F.lit("  "), "relay_id", F.lit(" ")),
            "requested_move_wk": F.when(key % 7 == 0, "not given").when(key % 5 == 0, F.concat(week, F.lit(" 08:30:00"))).otherwise(week),
        }
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts work in groups; the mid-sized among them are in a second, wider group."""
    part = raw(spark, sf_dir, "part").filter(F.col("p_size") <= 10)

    def member(prefix: str, span: int) -> DataFrame:
        return part.select(
            F.concat(F.lit(prefix), F.floor(F.col("p_partkey") / span).cast("string")).alias("adjustment_group_id"),
            F.col("p_partkey").cast("string").alias("relay_id"),
            (F.col("p_size") <= 6).alias("sync_required"),
            "p_size",
        )

    narrow = member("GROUP_", 35)
    wide = member("GROUPX_", 125).filter(F.col("p_size").between(5, 6))
    return conform(narrow.unionByName(wide), "groups")


def week_bounds_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last work week, straight from one column of the scan."""
    day = F.col("l_shipdate")
    return (
        raw(spark, sf_dir, "lineitem")
        .agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        .select(week_end(F.col("lo")).alias("first_week"), week_end(F.col("hi")).alias("last_week"))
    )


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    bounds = week_bounds_of(spark, sf_dir)
    return Tables(
        relays=relays(spark, sf_dir),
        stores=stores(spark, sf_dir),
        bridge=bridge(spark, sf_dir),
        requests=requests(spark, sf_dir),
        groups=groups(spark, sf_dir),
        holidays=conform(holiday_calendar(bounds), "holidays"),
        week_bounds=bounds,
    )
