"""Live counts, latest state and change requests over file streams.

Each query hands its changed rows to a `KeyedStore`, batch by batch. A
repeated batch replaces its own work, so a restart neither loses nor doubles
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekwise.session import materialize, scratch_path
from weekwise.streaming.store import KeyedStore


def event_stream(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", time: str = "ts", files_per_batch: int | None = 1000
) -> DataFrame:
    """File stream with `time` as a timestamp; a backlog is taken `files_per_batch` files at a time."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def tumbling_counts(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("event_count"))
        .select(F.col("w.start").alias("window_start"), "event_type", "event_count")
    )


def latest_by_key(events: DataFrame, key: str) -> DataFrame:
    """Newest event per key; ties by event id."""
    newest = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("s")
    return events.groupBy(key).agg(newest).select(key, "s.*")


def relay_reach(bridge: DataFrame) -> DataFrame:
    """One row per relay: its number of stores, and its weeks.

    Both as sets, which one shuffle merges: a relay's buffer holds each of its stores and weeks once.
    """
    stores = F.size(F.collect_set("store_id")).cast("bigint")
    return bridge.groupBy("relay_id").agg(stores.alias("n_stores"), F.collect_set("wk_end_date").alias("weeks"))


def live_requests(stream: DataFrame, reach: DataFrame, lateness: str = "60 days") -> DataFrame:
    """Change requests, each once, with the number of stores of its relay and whether it asks for one of its weeks.

    Requests come again and late: an id is taken once within the watermark
    on the request time, rows behind the watermark are dropped. The static
    side of the join has one row per relay, so the join adds no rows.
    """
    return (
        stream.observe("arrived", F.count("*").alias("n_rows"))
        .withWatermark("request_ts", lateness)
        .dropDuplicatesWithinWatermark(["request_id"])
        .observe("taken", F.count("*").alias("n_rows"))
        .join(reach, "relay_id", "left")
        .select(
            "request_id",
            "relay_id",
            "request_type",
            "status",
            "requested_move_wk",
            "request_ts",
            F.coalesce("n_stores", F.lit(0)).alias("n_stores"),
            F.coalesce(F.array_contains("weeks", F.col("requested_move_wk")), F.lit(False)).alias("in_own_week"),
        )
    )


def run_into(stream: DataFrame, store: KeyedStore, state: str, mode: str = "update") -> StreamingQuery:
    """Process what has arrived into the store; `state` is the query's checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store.upsert)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process all available input, then give the newest row per key.

    Checkpoint and store live in the shared folder.
    """
    spark = stream.sparkSession
    store = KeyedStore(spark, scratch_path(spark, "stream"), stream.schema, keys)
    run_into(stream, store, scratch_path(spark, "stream-state"))
    return store.read()


def intake(query: StreamingQuery) -> tuple[int, int, int]:
    """Rows that a run of `live_requests` saw, dropped as late, and took."""
    arrived = taken = late = 0
    for p in query.recentProgress:
        seen = {k: v["n_rows"] for k, v in (p.observedMetrics or {}).items()}
        arrived, taken = arrived + seen.get("arrived", 0), taken + seen.get("taken", 0)
        late += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
    return arrived, late, taken


def deliveries(requests: DataFrame, folder: str, column: str) -> Iterator[int]:
    """Hand over requests in deliveries: each number of `column`, ascending, adds its rows to the folder of a stream."""
    numbers = sorted(r[0] for r in requests.select(column).distinct().collect())  # a number per delivery
    for number in numbers:
        requests.filter(F.col(column) == number).drop(column).write.mode("append").parquet(folder)
        yield number


def run_deliveries(
    requests: DataFrame, bridge: DataFrame, column: str, lateness: str = "60 days"
) -> tuple[DataFrame, DataFrame]:
    """Stream deliveries of requests, with a new run of the query after each.

    Gives the requests taken, and per delivery the rows that arrived, came
    too late, repeated an earlier one, and were taken.
    """
    spark = requests.sparkSession
    reach = materialize(relay_reach(bridge), "reach")
    folder, state = scratch_path(spark, "requests"), scratch_path(spark, "requests-state")
    store, counts = None, []
    for number in deliveries(requests, folder, column):
        schema = spark.read.parquet(folder).schema
        source = event_stream(spark, folder, schema, time="request_ts", files_per_batch=None)
        stream = live_requests(source, reach, lateness)
        store = store or KeyedStore(spark, scratch_path(spark, "live-requests"), stream.schema, ["request_id"])
        arrived, late, taken = intake(run_into(stream, store, state, mode="append"))
        counts.append((number, arrived, late, arrived - late - taken, taken))
    if store is None:
        raise ValueError("no delivery")
    return store.read(), spark.createDataFrame(counts, "delivery int, arrived bigint, late bigint, repeated bigint, taken bigint")


def request_summary(taken: DataFrame) -> DataFrame:
    """Requests taken so far, the stores they reach and how many ask for a week of their own relay, by type and status."""
    return taken.groupBy("request_type", "status").agg(
        F.count("*").alias("requests"),
        F.sum("n_stores").alias("stores"),
        F.count(F.when(F.col("in_own_week"), 1)).alias("in_own_week"),
    )
