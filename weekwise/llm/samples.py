"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 for a null id, which is thus held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def sample_ids(rows: DataFrame, label: str, per_label: int, key: str = "doc_id") -> DataFrame:
    """Up to `per_label` ids of each label, evenly by hash: the same ones in every run.

    Ranks run inside (label, salt), so a label that most rows have is spread
    over several tasks, and a map-side limit precedes the shuffle.
    """
    order = F.xxhash64(F.col(key).cast("string"))
    salted = rows.select(key, label, order.alias("__order"), F.pmod(F.hash(key), F.lit(SALTS)).alias("__salt"))
    within = Window.partitionBy(label, "__salt").orderBy("__order", key)
    ranked = salted.withColumn("__rank", F.row_number().over(within))
    return ranked.filter(F.col("__rank") <= max(1, per_label // SALTS)).select(key, label)
