"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words; every document of it starts with the
same expected number of copies, target over size. The whole part is taken
at once. What remains is a fraction per document, rounded pivotally: two
fractional documents meet, word mass moves from one to the other in a
random direction, so that expectations stay, until one of them has no copy
or a whole one; the other meets the next. Mass is kept exactly, so a
group of documents ends with one fractional document at most; that one is rounded at
once and its fraction handed over to shorter documents, so a short one is left.

Groups are formed by hash inside a source (`leaf` documents each, so a hot
source is many groups), and their residual documents are combined group by
group in a reduction tree of fan-in `fan_in`, level by level in tables of
the shared folder; the last one of a source is rounded by chance. A source's
words thus differ from its target by less than one, usually short, document.

Random numbers are hashes of ids, texts and level, so rows that only share an id do not meet: the same rows give the same mix,
whatever the partitions.

Per-source totals (one row per source) are brought to the driver to share out
the targets; no document is.

Defined results
- null text has size 0. Documents of size 0 take nothing and do not meet others.
- null source is a source of its own, ordered last; null ids are documents.
- repeated rows are documents of their own and are rounded one by one; those of equal id and text meet in one group.
- all sizes 0 or an empty table: targets 0, nothing taken.
- extra columns pass through `mixed` and do not matter to `mix`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwise.llm.frames import column, only
from weekwise.llm.words import mix as scramble
from weekwise.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most_copies: float = 2.0
    leaf: int = 1024
    fan_in: int = 64
    seed: int = 17


def share_out(sizes: dict[str | None, int], p: MixParams = MixParams()) -> dict[str | None, float]:
    """Target per source: `share` of all words by weight, capped at `most_copies` times the source, excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    most = {s: p.most_copies * sizes[s] for s in order}
    target: dict[str | None, float] = {}
    free, rest = list(order), p.share * sum(sizes.values())
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most[s]]
        if not over:
            target.update({s: unit * weight[s] for s in free})
            break
        for s in over:
            target[s] = most[s]
            rest -= most[s]
        free = [s for s in free if s not in target]
    return target


def pivot(size: np.ndarray, mass: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Mass of each document after one pass; at most one stays strictly between 0 and its size."""
    mass = mass.astype(float).tolist()
    size, chance = size.tolist(), chance.tolist()
    i = -1
    for j in range(len(mass)):
        if not 0 < mass[j] < size[j]:
            continue
        if i < 0:
            i = j
            continue
        a, b, top_a, top_b = mass[i], mass[j], size[i], size[j]
        up, down = min(top_a - a, b), min(top_b - b, a)  # most that i, or j, can receive
        if chance[j] * (up + down) < down:  # with probability down / (up + down)
            a, b = (top_a, a + b - top_a) if up == top_a - a else (a + b, 0.0)
        else:
            a, b = (a + b - top_b, top_b) if down == top_b - b else (0.0, a + b)
        mass[i], mass[j] = a, b
        a_open, b_open = 0 < a < top_a, 0 < b < top_b
        i = i if a_open else j if b_open else -1
    return np.array(mass)


def hand_over(size: np.ndarray, mass: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Let the fractional document, usually a long one, pass its fraction on to shorter documents.

    It is rounded by chance; settled documents, shortest last, are turned
    back by as much mass in all, and the one that is turned in part is the new
    fractional document. Total mass stays, and with it the expected total.
    """
    left = np.flatnonzero((mass > 0) & (mass < size))
    if len(left) != 1:
        return mass
    i, mass = left[0], mass.copy()
    up = chance[i] * size[i] < mass[i]
    rest = size[i] - mass[i] if up else mass[i]  # to take from others, or to give to them
    others = np.flatnonzero((size > 0) & (size < size[i]) & (mass >= size if up else mass <= 0))
    if size[others].sum() < rest:
        return mass
    mass[i] = size[i] if up else 0.0
    # By chance, the shortest ones last: as many as are turned whole.
    others = others[np.argsort(chance[others], kind="stable")]
    total = np.cumsum(size[others])
    n = int(np.searchsorted(total, rest, "right"))
    whole, rest = others[:n], rest - (total[n - 1] if n else 0)
    mass[whole] = 0.0 if up else size[whole]
    enough = others[n:][size[others[n:]] > rest]
    if rest > 0 and len(enough):
        k = enough[size[enough].argmin()]
        mass[k] = size[k] - rest if up else rest
    elif rest > 0:
        k = others[n]
        mass[k] = size[k] - rest if up else rest
    return mass


def _level(rows: DataFrame, level: int, p: MixParams) -> DataFrame:
    """One level of the tree: rows of a (source, bucket) group meet; a group that is alone in its source ends."""

    def meet(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("size", "h")])
        table = table.take(pa.array(order))
        size, mass = table.column("size").to_numpy().astype(float), table.column("mass").to_numpy().astype(float)
        h = table.column("h").to_numpy().view(np.uint64)
        salt = np.uint64((p.seed * 0x9E3779B97F4A7C15 + level * 0xD6E8FEB86659FD93) % 2**64)
        chance = (scramble(h ^ salt) >> np.uint64(11)).astype(float) / 2**53
        mass = hand_over(size, pivot(size, mass, chance), chance)
        if table.column("buckets")[0].as_py() == 1:
            left = np.flatnonzero((mass > 0) & (mass < size))
            mass[left] = np.where(chance[left] * size[left] < mass[left], size[left], 0.0)
        copies = table.column("copies").to_numpy() + ((mass >= size) & (size > 0))
        still = (mass > 0) & (mass < size)
        for name, values in (("mass", pa.array(mass, mask=~still)), ("copies", pa.array(copies.astype(np.int64)))):
            table = table.set_column(table.schema.get_field_index(name), name, values)
        return table

    return rows.groupBy("source", "bucket").applyInArrow(meet, rows.schema)


def _mark(doc_id: F.Column, text: F.Column, p: MixParams) -> F.Column:
    return F.xxhash64(F.lit(p.seed), doc_id.cast("string"), text)


def mix(docs: DataFrame, p: MixParams = MixParams(), scratch: Scratch | None = None) -> DataFrame:
    """Per row of (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken."""
    return _chosen(docs, p, scratch).drop("h")


def _chosen(docs: DataFrame, p: MixParams, scratch: Scratch | None) -> DataFrame:
    """The mix with `h`, the mark of each row's id and text."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = only(docs, doc_id="doc_id", text="text", source="source")
    sized = rows.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _mark(F.col("doc_id"), F.col("text"), p).alias("h"),
    )
    sized = scratch.keep(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    target = share_out({r["source"]: r["size"] for r in totals}, p)
    plan = [(r["source"], r["size"], float(target[r["source"]]), max(1, -(-r["n"] // p.leaf))) for r in totals]
    kind = sized.schema["source"].dataType
    schema = T.StructType(
        [
            T.StructField("to_source", kind),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("buckets", T.LongType()),
        ]
    )
    planned = spark.createDataFrame(plan, schema)
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(rate)
    rows = sized.join(planned, F.col("source").eqNullSafe(F.col("to_source"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "h",
        F.pmod("h", F.col("buckets")).alias("bucket"),
        "buckets",
        whole.cast("long").alias("copies"),
        ((rate - whole) * F.col("size")).alias("mass"),
    )
    done, level = [], 0
    while True:
        rows = scratch.keep(_level(rows, level, p), f"level-{level}")
        done.append(rows.filter(F.col("mass").isNull()))
        rows = rows.filter(F.col("mass").isNotNull())
        if rows.isEmpty():
            break
        level += 1
        fan = F.lit(p.fan_in)
        rows = rows.withColumns(
            {
                "bucket": F.floor(F.col("bucket") / fan),
                "buckets": F.ceil(F.col("buckets") / fan),
            }
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "h"
    )


def mixed(docs: DataFrame, p: MixParams = MixParams(), scratch: Scratch | None = None) -> DataFrame:
    """`docs` with every row as often as the mix takes it."""
    chosen = _chosen(docs, p, scratch)
    # A struct as key lets null ids meet; rows that share id and text are matched in the order of source and size.
    key = F.struct(F.col("doc_id").alias("id"), "h")
    listed = chosen.groupBy(key.alias("__key")).agg(
        F.sort_array(F.collect_list(F.struct("source", "size", "copies"))).alias("__list")
    )
    rows = docs.withColumns({"__key": F.struct(column(docs, "doc_id").alias("id"), _mark(column(docs, "doc_id"), column(docs, "text"), p).alias("h"))}).join(listed, "__key")
    size = F.coalesce(F.regexp_count(column(docs, "text"), F.lit(WORD)), F.lit(0)).cast("long")
    order = Window.partitionBy("__key").orderBy(F.struct(column(docs, "source"), size))
    rows = rows.withColumn("__copies", F.get(F.col("__list"), F.row_number().over(order) - 1)["copies"].cast("int"))
    rows = rows.filter(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return rows.drop("__key", "__list", "__copies", "__copy")
