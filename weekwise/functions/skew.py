"""Joins whose hot keys are known from a mergeable counter sketch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, most: int = 256, tracked: int = 8192, parts: int | None = None) -> dict:
    """Keys with more rows than two average shuffle partitions, and the pieces to cut each into.

    Pieces are a quarter of an average partition, so that two in one task do no harm.
    One pass with a frequent-items sketch: at most `most` keys come back, and
    of those that hold more than a 1/`tracked`-th of the rows none is missed.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter(F.col(key).isNotNull())
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top")).first()
    share = max(1, found["n"] // parts)
    return {t["item"]: -(-4 * t["count"] // share) for t in found["top"] or [] if t["count"] > 2 * share}


def _pieces(key: str, hot: dict) -> Column:
    entries = [F.lit(x) for pair in hot.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[F.col(key)], F.lit(1))


def split_left_join(left: DataFrame, right: DataFrame, key: str, salt: list[str], hot: dict) -> DataFrame:
    """Left join in which the rows of hot keys on the right are dealt to several tasks.

    The right rows of a hot key are cut into pieces by the hash of `salt`, and
    only left rows with that key are repeated, once per piece. Other rows are
    joined as they are. `salt` columns do not reach the result.
    """
    if not hot:
        return left.join(right.drop(*salt), key, "left")
    piece = F.pmod(F.xxhash64(*salt), _pieces(key, hot))
    right = right.withColumns({"__piece": piece, "__hit": F.lit(True)}).drop(*salt)
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), (_pieces(key, hot) - 1).cast("bigint")))
    joined = left.withColumn("__piece", spread).join(right, [key, "__piece"], "left")
    # A hot key has rows on the right; where one of its pieces has none, nothing is to be added.
    return joined.filter(F.col("__hit") | (_pieces(key, hot) == 1)).drop("__piece", "__hit")
