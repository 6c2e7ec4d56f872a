"""Stages of a run that can be resumed.

A stage stores its table and, last of all, a manifest: the fingerprint of
its inputs, the schema and the number of rows. A later run reuses the
table if its own fingerprint and schema are the same, so a killed run goes on
where it stopped, and a changed input is computed anew with all that
follows from it. An empty stage stops the run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekwise.sources.io import EmptyInput


def file_fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes with the names, sizes and times of the files under `paths`; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    files = listed.select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    row = files.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


class Stages:
    """Stages of one run, stored under `folder`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.outcome: dict[str, tuple[int, bool]] = {}
        self._prints: dict[str, str] = {}

    def _manifest(self, name: str) -> dict | None:
        try:
            text = self.spark.read.text(f"{self.folder}/{name}/manifest").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(text[0]) if text else None

    def run(
        self, name: str, build: Callable[[], DataFrame], after: tuple[str, ...] = (), like: DataFrame | None = None, **inputs
    ) -> DataFrame:
        """The stage's table: stored by an earlier run with the same inputs, or built now.

        `after` names the stages it reads, `inputs` everything else that
        decides its rows, by a value or a fingerprint. A `build` that does
        work of its own is spared where the stage is reused if `like`, a
        frame with the columns that it will return, says what the schema is.
        """
        parts = [name, *(self._prints[s] for s in after), *(f"{k}={v!r}" for k, v in sorted(inputs.items()))]
        wanted = self._prints[name] = hashlib.sha256("|".join(parts).encode()).hexdigest()
        df, kept = build() if like is None else like, self._manifest(name)
        schema = df.schema.json()
        path = f"{self.folder}/{name}/{wanted}"
        reused = kept is not None and (kept["inputs"], kept["schema"]) == (wanted, schema)
        if not reused:
            built = df if like is None else build()
            if built.schema.simpleString() != df.schema.simpleString():
                raise ValueError(f"{name}: built {built.schema.simpleString()}, not {df.schema.simpleString()}")
            built.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        rows = kept["rows"] if reused else stored.count()
        if not rows:
            raise EmptyInput(f"{name}: no rows")
        if not reused:
            manifest = json.dumps({"inputs": wanted, "schema": schema, "rows": rows})
            line = self.spark.createDataFrame([(manifest,)], "value string").coalesce(1)
            line.write.mode("overwrite").text(f"{self.folder}/{name}/manifest")
        self.outcome[name] = (rows, reused)
        return stored
