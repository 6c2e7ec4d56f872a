"""A table of the newest row per key that micro-batches keep up to date.

Rows lie in buckets of their key's hash. A batch reads and rewrites only the
buckets it touches, into a folder of its own batch id; a small table says
which folder holds each bucket and is written last. So

- a read is one scan of at most `buckets` folders, whatever the number of batches;
- a batch that failed half-way is invisible, and one that is repeated starts
  from the same state and gives the same table;
- readers of the state before the last batch can finish: folders are deleted
  one batch after they were replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwise.session import discard
from weekwise.sources.io import load_table

PLACES = "bucket int, version bigint, batch_id bigint"


class KeyedStore:
    """Newest row per key under `path`; of equal keys in one batch the first by `order` stays."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64, order: tuple = ()
    ) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets, self.order = keys, buckets, list(order)

    def _places(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(bucket, version, batch) of the newest state, or the newest one before a batch."""
        none = lambda: self.spark.createDataFrame([], PLACES)
        places = load_table(self.spark, f"{self.path}/places", none)
        if before is not None:
            places = places.filter(F.col("batch_id") < before)
        last = places.agg(F.max("batch_id")).scalar()
        rows = places.filter(F.col("batch_id") == last).select("bucket", "version", "batch_id")
        return sorted(tuple(r) for r in rows.collect())  # a row per bucket

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/rows/version={version}/bucket={bucket}"

    def _rows(self, places: list[tuple[int, int, int]]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(b, v) for b, v, _ in places])

    def read(self) -> DataFrame:
        return self._rows(self._places())

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a batch; the same id again replaces what it did before."""
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")
        arrived = f"{self.path}/arrived"
        # Not by bucket: every task would write a file for each of them.
        batch.select(*self.schema.names, bucket).write.mode("overwrite").parquet(arrived)
        fields = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        batch = self.spark.read.schema(fields).parquet(arrived)
        places = self._places(before=batch_id)
        touched = {r["bucket"] for r in batch.select("bucket").distinct().collect()}  # numbers of buckets
        if touched:
            old = self._rows([p for p in places if p[0] in touched]).select("*", bucket, F.lit(0).alias("__new"))
            rows = old.unionByName(batch.withColumn("__new", F.lit(1)))
            pick = Window.partitionBy("bucket", *self.keys).orderBy(F.desc("__new"), *self.order)
            newest = rows.withColumn("__rank", F.row_number().over(pick)).filter("__rank = 1").drop("__rank", "__new")
            target = f"{self.path}/rows/version={batch_id}"
            newest.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        now = [(b, v) for b, v, _ in places if b not in touched] + [(b, batch_id) for b in touched]
        table = self.spark.createDataFrame([(b, v, batch_id) for b, v in now], PLACES).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/places/batch={batch_id}")
        self._compact(places, batch_id)

    def _compact(self, places: list[tuple[int, int, int]], batch_id: int) -> None:
        """Delete what the state before `places` held and neither it nor the new one needs."""
        if not places:
            return
        before = places[0][2]
        older = self._places(before=before)
        kept = {(b, v) for b, v, _ in places}
        gone = [self._folder(b, v) for b, v, _ in older if (b, v) not in kept]
        gone += [f"{self.path}/places/batch={m}" for m in {p[2] for p in older}]
        discard(self.spark, *gone)
