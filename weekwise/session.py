"""Session construction and runtime settings."""

from __future__ import annotations

import gc
import getpass
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: each of them can be changed on a live session.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where an operator above would then need
    # one more shuffle: a hot key may hold a third of all rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# For the planning queries, whose tables are long and narrow.
TABLES = {
    # A few bytes a row: what a map-side aggregate holds follows the size of
    # the splits, which must not grow with the table.
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.files.openCostInBytes": "1m",
    # The same after a shuffle: more partitions of a bounded size, put together where they are small;
    # `for_tables` deals more of them to larger tables.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Where no partition of a side is larger, AQE hashes it and spares both sorts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


PARTITION_BYTES = 2 << 20  # stored bytes of the tables for each partition of a shuffle
MOST_PARTITIONS = 10_000

# For queries whose large steps are stored one after the other: the shuffle files of a step go once it is stored.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# For work on long texts: a task's JVM and its Python worker each hold a few batches.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


# Settings that some call of `configure` made on top of RUNTIME.
_MORE: set[tuple[str, str]] = set()


def configure(spark: SparkSession, more: dict[str, str] | None = None) -> SparkSession:
    """Apply the runtime settings the operators are planned for and `more`, and take back what another query's `more` set."""
    wanted = {**RUNTIME, **(more or {})}
    for key, value in wanted.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _MORE.update((more or {}).items())
    for key, value in _MORE:
        if key not in wanted and spark.conf.get(key, None) == value:
            spark.conf.unset(key)
    return spark


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Size of the files under those of the paths that exist."""
    total = 0
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        total += system.getContentSummary(where).getLength() if system.exists(where) else 0
    return total


def for_tables(n_bytes: int) -> dict[str, str]:
    """TABLES for stored tables of that size: a task's share after a shuffle, and its memory, do not grow with them.

    AQE puts small partitions together but cannot take a large one apart below an aggregate.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = min(MOST_PARTITIONS, -(-n_bytes // PARTITION_BYTES))
    return {**TABLES, name: str(max(int(TABLES[name]), wanted))}


def build(app: str = "weekwise", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local work; on a cluster pass the one you were given to `configure`."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one named in `spark.checkpoint.dir`.

    Only a local master, where driver and tasks are one machine, may do
    without the setting; it then uses a folder of the user. A cluster
    without it is an error: no executor could read another one's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"weekwise-{getpass.getuser()}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), "weekwise", f"{label}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored intermediate tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished work holds: the driver's garbage, broadcast tables and shuffle files.

    Spark deletes those once the driver's JVM has collected the plans that
    made them, which an idle driver may not do for half an hour; a full
    collection also gives back heap that the JVM no longer needs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """The stored intermediate tables of one piece of work.

    `keep` stores a frame, `drop` deletes what is no longer read and `close`
    deletes the rest, for callers that have stored their own result.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.drop(label)
        path = self.paths[label] = scratch_path(self.spark, label)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        discard(self.spark, *[self.paths.pop(x) for x in labels if x in self.paths])

    def close(self) -> None:
        self.drop(*list(self.paths))

    def release(self) -> None:
        """Let go of the shuffle files behind stored tables."""
        release(self.spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table in the shared folder.

    The table outlives any executor, is computed once however often it is
    read, and gives later joins an exact size: Spark broadcasts it only if it
    is below `spark.sql.autoBroadcastJoinThreshold` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
