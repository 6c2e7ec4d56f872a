"""Order-dependent computations that no single task has to hold.

A window over one hot group, or an exact percentile over one column, would
put an unbounded group into one task. Both are split here: rows go into
buckets along the order, bucket totals are small, and only the position
inside a bucket needs the rows themselves.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekwise.session import materialize

WHOLE_BANDS = 1023


def size_band(size: Column) -> Column:
    """Size class: whole units up to 1023, beyond that one class per doubling."""
    whole = F.floor(size).cast("bigint")
    doubling = F.lit(WHOLE_BANDS - 10) + F.length(F.bin(whole))
    return F.when(whole <= WHOLE_BANDS, whole).otherwise(doubling).cast("int")


def running_before(
    df: DataFrame,
    group: str,
    size: str,
    key: str,
    totals: dict[str, str],
    hex_digits: int = 2,
    stop: tuple[str, str] | None = None,
) -> DataFrame:
    """Add, per row, the sums over all earlier rows of its group.

    Order inside a group: size class descending, then the first hex digits
    of the md5 of `key`, then size descending, the whole md5 and `key`.
    `totals` maps the summed column to the name of its running sum. Rows are
    bucketed by (group, size class, first hex digits), about 1080 * 16^digits
    buckets per group at most, so the window that runs over the buckets is
    bounded while a bucket holds 1/16^digits of a size class.

    `stop` names a running sum and a column, constant within a group, that
    bounds it: buckets that start at or beyond the bound hold no row below
    it and are dropped before their rows are shuffled and sorted: the buckets
    that are left are stored, so that Spark knows how few they are.
    """
    rows = df.withColumns({"__band": size_band(F.col(size)), "__md5": F.md5(F.col(key).cast("binary"))})
    rows = rows.withColumn("__hex", F.substring("__md5", 1, hex_digits))
    bucket = [group, "__band", "__hex"]

    along = Window.partitionBy(group).orderBy(F.desc("__band"), "__hex").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(c).alias(f"__sum_{c}") for c in totals]
    if stop:
        sums.append(F.max(stop[1]).alias("__bound"))
    starts = rows.groupBy(*bucket).agg(*sums).withColumns(
        {f"__start_{out}": F.coalesce(F.sum(f"__sum_{c}").over(along), F.lit(0)) for c, out in totals.items()}
    )
    if stop:
        starts = starts.filter(F.col(f"__start_{stop[0]}") < F.col("__bound"))
    starts = starts.select(*bucket, *[f"__start_{out}" for out in totals.values()])
    if stop:
        starts = materialize(starts, "starts")
    inside = Window.partitionBy(*bucket).orderBy(F.desc(size), "__md5", key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, bucket)
        .withColumns(
            {
                out: F.col(f"__start_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
                for c, out in totals.items()
            }
        )
        .drop("__band", "__md5", "__hex", *[f"__start_{out}" for out in totals.values()])
    )


def exact_percentile(df: DataFrame, value: str, share: float, scale: int = 2, fanout: int = 4096) -> float | None:
    """Exact percentile with linear interpolation over all non-null values."""
    return exact_percentiles(df, [value], share, scale, fanout)[0]


def exact_percentiles(
    df: DataFrame, values: list[str], share: float, scale: int = 2, fanout: int = 4096, accuracy: int = 1000
) -> list[float | None]:
    """Exact percentile of each column, with linear interpolation over its non-null values, in two passes over the rows.

    Values count as whole steps of 10^-scale. The first pass merges one
    quantile sketch per column, which gives a bracket around the rank that is
    wanted. The second counts what lies below the bracket and, by value,
    what lies inside. The sketch only chooses the bracket: if the rank is not
    in it, the column is counted over its whole range.
    """
    steps = [(F.col(c).cast(f"decimal(28,{scale})") * F.lit(10**scale)).cast("long") for c in values]
    margin = 2.0 / accuracy
    edges = [0.0, max(0.0, share - margin), min(1.0, share + margin), 1.0]
    sketch = df.agg(
        *[F.percentile_approx(v, edges, accuracy).alias(f"q{i}") for i, v in enumerate(steps)],
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(steps)],
    ).first()
    totals = [sketch[f"n{i}"] for i in range(len(values))]
    brackets = [sketch[f"q{i}"][1:3] if n else (0, 0) for i, n in enumerate(totals)]
    counts = _bracket_counts(df, steps, brackets)
    found: list[float | None] = []
    for i, total in enumerate(totals):
        if not total:
            found.append(None)
            continue
        own = counts.filter(F.col("which") == i)
        below, inside = own.agg(
            F.coalesce(F.sum(F.when(F.col("side") < 0, F.col("n"))), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)),
        ).first()
        position = Decimal(str(share)) * (total - 1)
        rank, part = int(position), position % 1
        last = rank + 1 if part else rank
        if not below <= rank <= last < below + inside:
            own = _bracket_counts(df, [F.lit(None).cast("long")] * i + [steps[i]], [(0, 0)] * i + [(-(2**63), 2**63 - 1)])
            own, below = own.filter(F.col("which") == i), 0
        lower, upper = _ranked(own.filter("side = 0"), below, rank, bool(part), fanout)
        exact = (lower + (upper - lower) * part) * Decimal(1).scaleb(-scale)
        found.append(float(exact.quantize(Decimal(1).scaleb(-scale - 4), rounding=ROUND_HALF_UP)))
    return found


def _bracket_counts(df: DataFrame, steps: list[Column], brackets: list[tuple[int, int]]) -> DataFrame:
    """(which, side, v, n): rows below (-1), inside (0) and above (1) the bracket of each column, by value inside it."""
    from weekwise.session import materialize

    sides = []
    for i, (v, (lo, hi)) in enumerate(zip(steps, brackets)):
        side = F.when(v < lo, -1).when(v > hi, 1).when(v.isNotNull(), 0)
        sides.append(F.struct(F.lit(i).alias("which"), side.alias("side"), F.when(side == 0, v).alias("v")))
    rows = df.select(F.explode(F.array(*sides)).alias("s")).select("s.*").filter("side IS NOT NULL")
    return materialize(rows.groupBy("which", "side", "v").agg(F.count("*").alias("n")), "value-counts")


def _ranked(counts: DataFrame, before: int, rank: int, with_next: bool, fanout: int) -> tuple[int, int]:
    """Values at `rank`, counted from 0, and if wanted at the next rank; `before` rows lie below `counts`.

    The range is split `fanout` ways until one value is left. Each round is
    an aggregation with at most `fanout` rows, of which one reaches the driver.
    """
    lo, hi = counts.agg(F.min("v"), F.max("v")).first()
    upto = before
    while True:
        width = max(1, math.ceil((hi - lo + 1) / fanout))
        parts = (
            counts.filter(F.col("v").between(lo, hi))
            .groupBy(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("long").alias("part"))
            .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        lo, hi, before, upto = (
            parts.withColumn("upto", F.sum("n").over(along) + F.lit(before))
            .filter(F.col("upto") > rank)
            .orderBy("part")
            .select("lo", "hi", F.col("upto") - F.col("n"), "upto")
            .first()
        )
        if lo == hi:
            break
    if with_next and rank + 1 >= upto:
        return lo, counts.filter(F.col("v") > lo).agg(F.min("v")).first()[0]
    return lo, lo


def weighted_threshold(
    rows: DataFrame, groups: DataFrame, group: str, value: str, weight: str, wanted: str, fanout: int = 256
) -> DataFrame:
    """(group, threshold): the smallest value whose rows up to it weigh `wanted` or more; null if all of them do not.

    `groups` has one row per group with its `wanted`, and is small enough to
    reach every task. A group's value range is split `fanout` ways around
    the wanted weight until one value is left, so a round is a plain
    aggregation with at most `fanout` rows per group and no task sorts a group.
    """
    from weekwise.session import materialize

    totals = (
        rows.select(F.col(group), F.col(value).cast("double").alias("__v"), F.col(weight).alias("__w"))
        .groupBy(group, "__v")
        .agg(F.sum("__w").alias("__w"))
    )
    totals = materialize(totals, "weights")
    spans = totals.groupBy(group).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.sum("__w").alias("all"))
    open_ = groups.select(group, F.col(wanted).alias("wanted")).join(spans, group)
    open_ = materialize(
        open_.filter(F.col("all") >= F.col("wanted")).select(group, "wanted", "lo", "hi", F.lit(0).cast("decimal(38,6)").alias("before")),
        "spans",
    )
    while not open_.filter("lo < hi").isEmpty():
        width = (F.col("hi") - F.col("lo")) / F.lit(float(fanout))
        part = F.when(F.col("lo") == F.col("hi"), F.lit(0)).otherwise(
            F.least(F.lit(fanout - 1), F.floor((F.col("__v") - F.col("lo")) / width).cast("int"))
        )
        inside = totals.join(F.broadcast(open_), group).filter(F.col("__v").between(F.col("lo"), F.col("hi")))
        parts = (
            inside.withColumn("part", part)
            .groupBy(group, "wanted", "before", "part")
            .agg(F.sum("__w").alias("w"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        )
        along = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        reached = parts.withColumn("upto", F.col("before") + F.sum("w").over(along)).filter(F.col("upto") >= F.col("wanted"))
        first = Window.partitionBy(group).orderBy("part")
        open_ = materialize(
            reached.withColumn("rn", F.row_number().over(first))
            .filter("rn = 1")
            .select(group, "wanted", "lo", "hi", (F.col("upto") - F.col("w")).cast("decimal(38,6)").alias("before")),
            "spans",
        )
    return groups.select(group).join(open_.select(group, F.col("lo").alias("threshold")), group, "left")
