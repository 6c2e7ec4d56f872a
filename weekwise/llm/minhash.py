"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each text gets its set of word shingles, and from one hash per shingle a
   signature: the hash range is cut into bins and a bin keeps its smallest
   value; an empty bin takes the value of the first full bin on a probe
   sequence of its own (optimal densification).
2. Texts with equal sets are one class, represented by the smallest id.
3. Bands of `rows` bins make buckets. The members of a bucket get an edge to
   its smallest id only, so candidate edges grow with the members, not with
   their square. Of a text's edges the one that most bands support is
   confirmed first, on the full sets, and components are formed.
4. What stars can miss: buckets that still hold several components are
   compared inside, in blocks of bounded size; members of different
   components that may be linked form families. A family is compared again,
   now on the full sets, block against block. A block gives back a forest,
   at most one link per member, never its pairs.

Step 4 rules a pair out by bounds that hold for every pair, never by an
estimate: the sizes of the sets, and their parity bitmaps, which differ in no
more bits than the sets differ in shingles. So a link is lost only if its texts
share no bucket. With 36 bands of 3 bins that has probability
(1 - 0.75^3)^36 < 3e-9 at similarity 0.75 if bins were independent; those of
sets smaller than the bins are not quite.

Defined results
- null, empty and white-space texts: empty set, n_shingles 0, linked with
  nothing, kept. Fewer words than `words`: the whole sequence is the one shingle.
- rows that share an id are judged by their own text each; a null id never
  stands for a class with other ids and keeps its row.
- ties: the smallest id always wins. Empty table: no rows.
- extra columns do not matter to `link`; `dedup` keeps them as they are.
- a very long text is read whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwise.llm.components import components
from weekwise.llm.frames import column, only
from weekwise.llm.words import Texts, mix, sequence_hash, texts, window_hashes
from weekwise.session import Scratch


@dataclass(frozen=True)
class MinHashParams:
    words: int = 5
    percent: int = 75
    bands: int = 36
    rows: int = 3
    block: int = 512

    @property
    def bins(self) -> int:
        return self.bands * self.rows


PROBES = 512
PARITY_BITS = 1 << 16  # most bits of a bitmap


def shingle_sets(t: Texts, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = t.hashes()
    all_windows = window_hashes(h, words)
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist()):
        if b - a >= words:
            yield np.unique(all_windows[a : b - words + 1])
        elif b > a:
            yield np.array([sequence_hash(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(values: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each bin, densified; `values` sorted and not empty."""
    at = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    head = np.r_[True, at[1:] != at[:-1]]
    full = np.zeros(bins, bool)
    least = np.zeros(bins, np.uint64)
    full[at[head]] = True
    least[at[head]] = values[head]
    empty = np.flatnonzero(~full)
    if len(empty):
        found = full[probes[:, empty]]
        hit = found.argmax(axis=0)
        source = np.where(found.any(axis=0), probes[hit, empty], int(at[0]))
        least[empty] = least[source]
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def parity(values: np.ndarray) -> bytes:
    """Bitmap of the parities of a set's hash counts: 4 to 8 bits a shingle, a power of two, its halves fold by xor."""
    width = min(PARITY_BITS, max(256, 4 << max(0, len(values) - 1).bit_length()))
    at = (mix(values) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def sketches(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set and signature (both null for an empty set)."""
    bins = p.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = np.random.default_rng(11).integers(0, bins, (PROBES, bins))
        for batch in batches:
            for lo, t in texts(batch.column(1), lower=True):
                sizes, digests, signs = [], [], []
                for s in shingle_sets(t, p.words):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signs.append(signature(s, bins, probes).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(t)),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(signs, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, digest binary, signature binary")


def full_sets(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc_id, shingles, bits): the sorted distinct shingle hashes, 8 bytes each, and their parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, t in texts(batch.column(1), lower=True):
                sets, bits = [], []
                for s in shingle_sets(t, p.words):
                    sets.append(s.tobytes())
                    bits.append(parity(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(t)), pa.array(sets, pa.binary()), pa.array(bits, pa.binary())],
                    ["doc_id", "shingles", "bits"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, shingles binary, bits binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    # The sizes alone rule out many pairs.
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = _common(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: a, b, similarity.

    The second join is on a, the centre that many pairs share; its rows then
    carry b's set, so Spark can split a hot centre by size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows)
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = _common(x, y)
                share[i], linked[i] = both / max(1, len(x) + len(y) - both), _linked(x, y, p.percent)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(share[linked])],
                ["a", "b", "similarity"],
            )

    id_type = pairs.schema["a"].dataType.simpleString()
    of_b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    of_a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    rows = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(run, f"a {id_type}, b {id_type}, similarity double")


def _mixed(members: DataFrame, parts: DataFrame, marks: DataFrame) -> DataFrame:
    """Members, with component, set size and bitmap, of buckets that hold several components; one of equal buckets."""
    placed = members.select("key", "n", "doc_id").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    buckets = placed.groupBy("key").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"),
    )
    keys = buckets.filter(F.col("lo") < F.col("hi")).groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    return placed.join(keys.select("key"), "key", "left_semi").join(marks, "doc_id")


class _Forest:
    """Union-find over the rows of one block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _in_blocks(rows: DataFrame, group: str, size: str, block: int, compare, schema: str) -> DataFrame:
    """Apply `compare` to every pair of blocks of each group; a group within one block is compared with itself."""
    parts = F.ceil(F.col(size) / F.lit(block)).cast("int")
    cut = rows.withColumns({"parts": parts, "part": F.pmod(F.hash("doc_id"), parts)})
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    return cut.drop("parts", "other", size).groupBy(group, "low", "high").applyInArrow(compare, schema)


def _alike(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row of the lower block and rows of the higher one that belong elsewhere and that no bound rules out.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their
    shingles, and in a third of their sizes, so their bitmaps are of one width or
    the next one; a pair is compared in the narrower width.
    """
    comp, part = table.column("component").to_numpy(), table.column("part").to_numpy()
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    size, raw = table.column("set_size").to_numpy(), table.column("bits").to_pylist()
    width = np.array([len(b) for b in raw])
    for w in np.unique(width).tolist():
        near = np.flatnonzero((width == w) | (width == 2 * w))
        bits = [np.frombuffer(raw[k], np.uint64).reshape(-1, w // 8) for k in near.tolist()]
        bits = np.stack([np.bitwise_xor.reduce(b, axis=0) for b in bits])
        in_left, in_right = np.flatnonzero(part[near] == low), np.flatnonzero(part[near] == high)
        right, across = near[in_right], bits[in_right]
        theirs, sizes, native = comp[right], size[right], width[right] == w
        for k, at in enumerate(in_left.tolist()):
            i = near[at]
            first = k + 1 if low == high else 0
            may = theirs[first:] != comp[i]
            may &= 100 * np.minimum(sizes[first:], size[i]) >= percent * np.maximum(sizes[first:], size[i])
            if width[i] != w:
                may &= native[first:]
            apart = np.flatnonzero(may) + first
            if len(apart):
                differ = np.bitwise_count(across[apart] ^ bits[at]).sum(axis=1, dtype=np.int64)
                found = right[apart[(100 + percent) * differ <= (100 - percent) * (sizes[apart] + size[i])]]
                if len(found):
                    yield int(i), found


def _families(live: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (a, b) that join all members of a bucket that may be linked across components: a forest per block."""

    def compare(table: pa.Table) -> pa.Table:
        ids, forest = table.column("doc_id").to_numpy(), _Forest(table.num_rows)
        pairs = [(i, j) for i, found in _alike(table, p.percent) for j in found.tolist() if forest.join(i, j)]
        kind = table.schema.field("doc_id").type
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], kind), "b": pa.array([ids[j] for _, j in pairs], kind)})

    kind = live.schema["doc_id"].dataType.simpleString()
    return _in_blocks(live, "key", "n", p.block, compare, f"a {kind}, b {kind}")


def _confirm_inside(family: DataFrame, p: MinHashParams) -> DataFrame:
    """Links (a, b), confirmed on the full sets, that join all linked members of a family: a forest per block."""

    def compare(table: pa.Table) -> pa.Table:
        ids, forest, links = table.column("doc_id").to_numpy(), _Forest(table.num_rows), []
        comp = table.column("component").to_numpy()
        _, first, same = np.unique(comp, return_index=True, return_inverse=True)
        for i, j in enumerate(first[same.ravel()].tolist()):
            forest.join(i, j)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").combine_chunks()]
        for i, found in _alike(table, p.percent):
            for j in found.tolist():
                if forest.root(i) != forest.root(j) and _linked(sets[i], sets[j], p.percent):
                    forest.join(i, j)
                    links.append((ids[i], ids[j]))
        kind = table.schema.field("doc_id").type
        return pa.table({"a": pa.array([a for a, _ in links], kind), "b": pa.array([b for _, b in links], kind)})

    kind = family.schema["doc_id"].dataType.simpleString()
    return _in_blocks(family, "family", "members", p.block, compare, f"a {kind}, b {kind}")


def link(docs: DataFrame, p: MinHashParams = MinHashParams(), scratch: Scratch | None = None) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    Intermediate tables go through `scratch`; close it once the result is stored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = only(docs, doc_id="doc_id", text="text")
    signs = scratch.keep(sketches(rows, p), "signatures")
    classes = signs.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.keep(classes, "classes")
    single = signs.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"])
    single = single.select("doc_id", "signature")

    # Buckets with at least two classes.
    width = 2 * p.rows
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(p.bands)])
    banded = single.select("doc_id", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n"), F.max("doc_id").alias("last"))
    shared = shared.filter(F.col("centre") < F.col("last")).drop("last")
    members = scratch.keep(banded.join(shared, "key"), "members")

    # Star edges; the best supported one of each class is tried first.
    stars = members.filter(F.col("doc_id") != F.col("centre")).groupBy("doc_id", "centre").agg(F.count("*").alias("n"))
    best = stars.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "centre")).alias("best"))
    pairs = best.select(F.col("best.centre").alias("a"), F.col("doc_id").alias("b"))
    sought = members.select("doc_id").distinct()
    sets = scratch.keep(full_sets(rows.join(sought, "doc_id", "left_semi"), p), "sets")
    links = scratch.keep(confirm(pairs, sets, p).select("a", "b").distinct(), "links-0")
    parts = scratch.keep(components(links, scratch), "parts")
    scratch.release()

    # Buckets that still hold several components: what stars may have missed.
    sets = sets.withColumn("set_size", F.shiftright(F.octet_length("shingles"), 3).cast("long"))
    marks = sets.select("doc_id", "set_size", "bits").dropDuplicates(["doc_id"])
    close = scratch.keep(_families(_mixed(members, parts, marks), p).distinct(), "close")
    placed = parts.withColumnRenamed("node", "doc_id")
    inside = close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct().join(placed, "doc_id", "left")
    inside = scratch.keep(inside.withColumn("component", F.coalesce("component", "doc_id")), "inside")
    near = close.union(inside.select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
    family = components(near, scratch, "families").select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    family = scratch.keep(inside.join(family, "doc_id"), "family")
    scratch.release()
    counts = family.groupBy("family").agg(F.count("*").alias("members"))
    family = family.join(counts, "family").join(sets, "doc_id")
    more = _confirm_inside(family, p)
    links = scratch.keep(links.union(more).distinct(), "links-1")
    parts = scratch.keep(components(links, scratch), "parts-1")

    classed = signs.drop("signature").join(classes, "digest", "left")
    found = classed.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def dedup(docs: DataFrame, p: MinHashParams = MinHashParams(), scratch: Scratch | None = None) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest id. Rows without an id stay.

    Of several rows with that id the first by text and then by all columns stays.
    """
    ids = column(docs, "doc_id")
    kept = link(docs, p, scratch).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    order = [column(docs, "text"), F.xxhash64(*[column(docs, c) for c in docs.columns])]
    numbered = docs.join(kept, ids == F.col("__id"), "left_semi").withColumn(
        "__rank", F.row_number().over(Window.partitionBy(ids).orderBy(*order))
    )
    return numbered.filter("__rank = 1").drop("__rank").union(docs.filter(ids.isNull()))
