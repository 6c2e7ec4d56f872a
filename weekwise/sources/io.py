"""Sources and sinks: SQL text, stored tables with fallback, CSV and JSON exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekwise.functions.columns import lenient_date
from weekwise.session import scratch_path
from weekwise.sources.schemas import LOGICAL, Tables, clean_keys, conform, fields, week_bounds


class EmptyInput(ValueError):
    """A stage got no rows to work on."""


def load_stored(spark: SparkSession, folder: str) -> Tables:
    """The six logical tables from a folder of parquet tables; a missing one raises."""
    frames = {
        name: clean_keys(conform(spark.read.schema(ddl).parquet(f"{folder}/{name}"), name)) for name, ddl in LOGICAL.items()
    }
    return Tables(**frames, week_bounds=week_bounds(frames["relays"]))


def row_counts(tables: Tables) -> DataFrame:
    frames = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.named().items()
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sql_source(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text; `{name}` in it stands for a frame. Errors raise."""
    return spark.sql(text, **frames)


def save_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> str:
    """Persist an intermediate table.

    With `partition_by` a reader that filters on those columns opens only their folders.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def load_table(spark: SparkSession, path: str, fallback: Callable[[], DataFrame] | None = None) -> DataFrame:
    """A stored table; where it is missing or empty, the fallback, if there is one."""
    try:
        df = spark.read.parquet(path)
        if fallback is None or not df.isEmpty():
            return df
    except AnalysisException as e:
        if fallback is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
    return fallback()


def require_rows(df: DataFrame, stage: str) -> DataFrame:
    """Guard between stages: an empty input stops the run."""
    if df.isEmpty():
        raise EmptyInput(f"{stage}: no rows")
    return df


def checkpoint_roundtrip(df: DataFrame, partition_by: list[str]) -> DataFrame:
    spark = df.sparkSession
    return load_table(spark, save_table(df, scratch_path(spark, "table"), partition_by))


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def csv_export(df: DataFrame) -> DataFrame:
    """Write a frame as CSV with a header and read it back with its schema."""
    spark = df.sparkSession
    path = export_csv(df, scratch_path(spark, "csv"))
    return spark.read.schema(df.schema).option("header", True).csv(path)


def export_sorted(df: DataFrame, path: str, *keys: str) -> str:
    """Write a listing in the order of `keys`: a range of them per file, sorted inside, files in order of name."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path


def load_sorted(spark: SparkSession, path: str) -> DataFrame:
    """A sorted listing with the `position` of each row, from 1.

    Rows are numbered by their place in the file and the rows of the files
    before it, of which there is one count each.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = rows.groupBy("__file").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    placed = rows.join(F.broadcast(starts), "__file")
    return placed.withColumn("position", F.col("__start") + F.col("__row") + 1).drop("__file", "__row", "__start")


def load_text(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A logical table from CSV text: keys trimmed, dates and times where they parse, else null."""
    wanted = fields(LOGICAL[table])
    raw = spark.read.schema(", ".join(f"{c} STRING" for c in wanted)).option("header", True).csv(path)

    def typed(name: str, kind: str):
        if kind == "DATE":
            return lenient_date(F.col(name))
        if kind == "STRING":
            return F.col(name)
        return F.col(name).try_cast(kind)

    return clean_keys(raw.select(*[typed(c, t).alias(c) for c, t in wanted.items()]))


def export_text(df: DataFrame, path: str) -> str:
    """Write a one-column frame (a JSON document) as text."""
    df.write.mode("overwrite").text(path)
    return path
