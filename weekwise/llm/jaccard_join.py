"""Jaccard join of word n-gram sets through a token-group matrix.

Two sets are linked if their intersection holds `percent` per cent of their
union. Then it holds that share of the larger set too, so a token of the
smaller set's short prefix lies in the larger set's prefix, in any one order
of all tokens. Tokens are ordered by a sketch of their counts, rare ones first.

1. Texts with equal sets are one class, represented by the smallest id.
2. Classes that share a prefix token meet in its bucket. Each is compared, on
   the full sets, with the smallest id of the bucket that most of its tokens
   share; components are formed. Buckets inside one component are done.
3. The members of the other buckets are partitioned into groups of similar
   documents: slices of one component, or classes without a link that share their
   most common bucket, alike in size; bounded in members and tokens. The matrix
   has a cell for each prefix token and group.
4. A class is a query to each group that the matrix gives it for its own
   prefix, unless sizes or a common component rule the group out. Queries meet
   their group in blocks of bounded size, where the group's token union bounds
   the overlap of the query with every member; only groups whose bound reaches
   the share are opened, and all overlaps with the members are counted. A
   block gives back a forest, at most one link for each of its rows.

All bounds hold for every pair, so no link is lost; the sketch, which holds
64 MB at most, only decides how early rare tokens come. Full sets are made
from the texts where they are needed, behind a bitmap of the ids in question.

Defined results
- null, empty and white-space texts: empty set, n_shingles 0, linked with
  nothing. Fewer words than `words`: the whole sequence is the one shingle.
- repeated rows and equal sets are one class. Rows that share an id are judged
  by their own text each. A null id never stands for a class; its row has the
  component of its class, null if no other id is in it.
- ties: the smallest id wins. Empty table: no rows.
- extra columns, whatever their names, do not matter.
- a very long text is read whole by one task.

Shingles are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.llm.components import components
from weekwise.llm.frames import only
from weekwise.llm.minhash import shingle_sets
from weekwise.llm.words import mix, texts
from weekwise.session import Scratch


@dataclass(frozen=True)
class JoinParams:
    words: int = 3
    percent: int = 90
    max_cells: int = 1 << 27
    group_members: int = 256
    group_tokens: int = 1 << 19
    block_queries: int = 512
    block_tokens: int = 1 << 20
    id_bits: int = 1 << 25

    def probed(self, n: int) -> int:
        """Prefix of a set of n that meets every linked set of n tokens at most in its indexed prefix."""
        return n + (-self.percent * n // 100) + 1

    def indexed(self, n: int) -> int:
        return n + (-2 * self.percent * n // (100 + self.percent)) + 1


BLOCK = 1 << 16


def _cells(tokens: np.ndarray, width: int) -> np.ndarray:
    return (tokens >> np.uint64(8)) & np.uint64(width - 1)


def _levels(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Levels of cells; a byte holds two of them."""
    at = cell.astype(np.int64)
    return (table[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15


def token_levels(docs: DataFrame, width: int, p: JoinParams) -> bytes:
    """Count sketch: for each cell half the logarithm's steps of the number of tokens that fell there, up to 15."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = (cell // np.uint64(BLOCK)).astype(np.int32)
            cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(cell)]
            offset, n = (cell % np.uint64(BLOCK)).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
            parts = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in (offset, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(block[cuts[:-1]]), *(pa.array(x, pa.binary()) for x in parts)], ["block", "cells", "counts"]
            )

        size = 0
        for batch in batches:
            for _, t in texts(batch.column(0), lower=True):
                found = [_cells(s, width) for s in shingle_sets(t, p.words) if len(s)]
                held += found
                size += sum(map(len, found))
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(BLOCK, np.int64)

        def level() -> pa.RecordBatch:
            levels = np.minimum(15, np.rint(2 * np.log2(1 + total))).astype(np.uint8)
            packed = (levels[::2] | (levels[1::2] << 4)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["block", "levels"])

        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    if at is not None:
                        yield level()
                    at, total = block, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint8)
        if at is not None:
            yield level()

    parts = docs.select("text").mapInArrow(count, "block int, cells binary, counts binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, levels binary")
    table = bytearray(max(width, BLOCK) // 2)
    for block, levels in merged.toLocalIterator():  # at most width / BLOCK rows
        table[block * BLOCK // 2 : (block + 1) * BLOCK // 2] = levels
    return bytes(table)


def signed(docs: DataFrame, levels: bytes, width: int, p: JoinParams) -> DataFrame:
    """Per row: doc_id, n, digest of the set (null if empty) and its probed prefix, rare tokens first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for lo, t in texts(batch.column(1), lower=True):
                sizes, digests, prefixes = [], [], []
                for s in shingle_sets(t, p.words):
                    # Ascending tokens and a stable sort: one order for all sets.
                    rank = (_levels(level, _cells(s, width)).astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    prefixes.append(s[np.argsort(rank, kind="stable")[: p.probed(len(s))]].tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(t)),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(prefixes, pa.binary()),
                    ],
                    ["doc_id", "n", "digest", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, digest binary, prefix binary")


def prefix_tokens(single: DataFrame, p: JoinParams) -> DataFrame:
    """(token, doc_id, n, indexed): a row for each token of the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                tokens = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                n = part.column(1).to_pylist()
                row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
                indexed = [np.arange(len(x)) < p.indexed(k) for x, k in zip(tokens, n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens)),
                        part.column(0).take(pa.array(row)),
                        part.column(1).take(pa.array(row)),
                        pa.array(np.concatenate(indexed)),
                    ],
                    ["token", "doc_id", "n", "indexed"],
                )

    kind = single.schema["doc_id"].dataType.simpleString()
    rows = single.select("doc_id", "n", "prefix")
    return rows.mapInArrow(run, f"token bigint, doc_id {kind}, n bigint, indexed boolean")


def token_sets(docs: DataFrame, ids: DataFrame, p: JoinParams, dealt: bool = True) -> DataFrame:
    """(doc_id, n, tokens): the sorted distinct shingle hashes, 8 bytes each, of at least the documents in `ids`.

    Texts stay where they are: a bitmap of hashed ids, whatever their number, picks the rows to read. `dealt` rows
    lie by id, so that a join on the id follows without a shuffle.
    """
    wanted = ids.agg(F.count("*")).first()[0]
    bits = 1 << min(max(10, (16 * wanted).bit_length()), p.id_bits.bit_length() - 1)
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.groupBy(F.shiftright(cell, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(doc_id), 32) AS INT))")).alias("bits"))
    held = words.toPandas()  # at most id_bits / 32 rows
    table = np.zeros(bits >> 5, np.int64)
    table[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
            for lo, t in texts(batch.column(1), lower=True):
                sets = list(shingle_sets(t, p.words))
                full = pa.array([len(s) > 0 for s in sets], pa.bool_())
                columns = [
                    batch.column(0).slice(lo, len(t)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(mix(s))) for s in sets], pa.uint64()).view(pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in columns], ["doc_id", "n", "hash", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", cell.alias("cell"))
    found = rows.mapInArrow(run, f"doc_id {kind}, n bigint, hash bigint, tokens binary")
    found = found.repartition("doc_id") if dealt else found
    return found.dropDuplicates(["doc_id", "n", "hash"]).drop("hash")  # one of repeated rows


def _reached(both, x, y, percent: int):
    """Whether the intersection is large enough for sets of sizes x and y."""
    return (both > 0) & (100 * both >= percent * (x + y - both))


def confirmed(pairs: DataFrame, docs: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) that are linked. The join on a, which many pairs share, comes last and can be split by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                may = 100 * min(len(x), len(y)) >= p.percent * max(len(x), len(y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if may else 0
                keep.append(bool(_reached(both, len(x), len(y), p.percent)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    def sets_of(side: str, dealt: bool) -> DataFrame:
        sets = token_sets(docs, pairs.select(F.col(side).alias("doc_id")).distinct(), p, dealt)
        return sets.select(F.col("doc_id").alias(side), F.col("tokens").alias(f"set_{side}"))

    kind = pairs.schema["a"].dataType.simpleString()
    rows = pairs.select("a", "b").join(sets_of("b", True), "b").join(sets_of("a", False), "a")
    rows = rows.select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def open_buckets(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with their component, of buckets that hold several components; one of equal buckets."""
    placed = members.select("token", "doc_id", "n", "indexed").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumns({"linked": F.col("component").isNotNull(), "component": F.coalesce("component", "doc_id")})
    buckets = placed.groupBy("token").agg(
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.count("*").alias("size"),
        F.max("indexed").alias("any_indexed"),
        F.bit_xor(F.xxhash64("doc_id", "n", "indexed")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "doc_id", "n", "indexed")).alias("y"),
    )
    mixed = buckets.filter((F.col("lo") < F.col("hi")) & F.col("any_indexed"))
    keys = mixed.groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token", "size")
    return placed.join(keys, "token")


def grouped(open_rows: DataFrame, p: JoinParams) -> DataFrame:
    """(doc_id, n, component, gid): a group of similar documents for each indexed one."""
    # Sizes of one band differ by a tenth at most.
    band = F.floor(F.log(F.col("n").cast("double")) * F.lit(10.0)).cast("long")
    home = F.max(F.struct("size", "token"))["token"]
    docs = open_rows.filter("indexed").groupBy("doc_id", "n", "component", "linked").agg(home.alias("home"))
    key = F.when(F.col("linked"), F.xxhash64(F.lit("component"), "component")).otherwise(F.xxhash64(F.lit("token"), "home"))
    docs = docs.withColumns({"key": key, "band": band})
    slots = F.greatest(F.ceil(F.count("*") / p.group_members), F.ceil(F.sum("n") / p.group_tokens)).cast("long")
    counts = docs.groupBy("key", "band").agg(slots.alias("slots"))
    slot = F.pmod(F.xxhash64("doc_id", "n"), F.col("slots"))
    docs = docs.join(counts, ["key", "band"]).withColumn("gid", F.xxhash64("key", "band", slot))
    return docs.select("doc_id", "n", "component", "gid")


def queries_of_groups(open_rows: DataFrame, groups: DataFrame, p: JoinParams) -> DataFrame:
    """(gid, doc_id, n, component): each query that the matrix sends to a group."""
    stats = groups.groupBy("gid").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    cells = open_rows.filter("indexed").select("token", "doc_id", "n").join(groups.drop("component"), ["doc_id", "n"])
    matrix = cells.select("token", "gid").distinct().join(stats, "gid")
    # Members are no larger than their query; larger documents ask for themselves.
    may = (F.col("least") <= F.col("n")) & (100 * F.col("most") >= p.percent * F.col("n"))
    same = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("component"))
    found = open_rows.select("token", "doc_id", "n", "component").join(matrix, "token").filter(may & ~same)
    return found.select("gid", "doc_id", "n", "component").distinct()


def _links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Rows (query, member) of one block that link different components: a forest."""
    query = table.column("query").to_numpy()
    n, comp = table.column("n").to_numpy(), table.column("component").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    members, queries = np.flatnonzero(~query), np.flatnonzero(query)
    if not len(members) or not len(queries):
        return []
    owner = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
    tokens = np.concatenate([sets[i] for i in members])
    order = np.argsort(tokens, kind="stable")
    union, first = np.unique(tokens[order], return_index=True)
    owner, ends = owner[order], np.r_[first[1:], len(tokens)]
    up: dict = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    found = []
    for i in queries.tolist():
        at = np.minimum(np.searchsorted(union, sets[i]), len(union) - 1)
        at = at[union[at] == sets[i]]
        if 100 * len(at) < percent * max(n[i], n[members].min()):
            continue  # the bound: no member shares more than the union does
        length = ends[at] - first[at]
        take = np.repeat(first[at] - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
        both = np.bincount(owner[take], minlength=len(members))
        for k in np.flatnonzero(_reached(both, n[i], n[members], percent)).tolist():
            a, b = root(comp[i]), root(comp[members[k]])
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((i, int(members[k])))
    return found


def opened(queries: DataFrame, groups: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    """Links (a, b) between queries and members of the groups that their bound lets open."""
    blocks = F.greatest(F.ceil(F.count("*") / p.block_queries), F.ceil(F.sum("n") / p.block_tokens)).cast("long")
    counts = queries.groupBy("gid").agg(blocks.alias("blocks"))
    asked = queries.join(counts, "gid").withColumn("block", F.pmod(F.xxhash64("doc_id", "n"), F.col("blocks")))
    asked = asked.select("gid", "block", "doc_id", "n", "component", F.lit(True).alias("query"))
    held = groups.join(counts, "gid").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    held = held.select("gid", "block", "doc_id", "n", "component", F.lit(False).alias("query"))
    rows = asked.union(held).join(sets.withColumnRenamed("n", "size"), "doc_id")
    rows = rows.filter("n = size")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id")
        found = _links(table, p.percent)
        a, b = ([x[k] for x in found] for k in (0, 1))
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    kind = sets.schema["doc_id"].dataType.simpleString()
    rows = rows.select("gid", "block", "query", "doc_id", "n", "component", "tokens")
    return rows.groupBy("gid", "block").applyInArrow(compare, f"a {kind}, b {kind}")


def similar(docs: DataFrame, p: JoinParams = JoinParams(), scratch: Scratch | None = None) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id.

    Intermediate tables go through `scratch`; close it once the result is stored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = only(docs, doc_id="doc_id", text="text")
    n_bytes = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    width = 1 << min(max(16, (2 * n_bytes // 6).bit_length()), p.max_cells.bit_length() - 1)
    signs = scratch.keep(signed(rows, token_levels(rows, width, p), width, p), "signs")
    classes = signs.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = scratch.keep(classes, "classes")
    single = signs.join(classes.select("digest", F.col("class_id").alias("doc_id")), ["digest", "doc_id"])
    single = single.dropDuplicates(["digest", "doc_id"])

    single = scratch.keep(single.dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "prefix"), "single")

    # Buckets of two documents or more, of which one is indexed.
    tokens = prefix_tokens(single, p)
    centre = F.min(F.struct("doc_id", "n"))
    shared = tokens.groupBy("token").agg(centre.alias("centre"), F.max("doc_id").alias("last"), F.max("indexed").alias("indexed_any"))
    shared = shared.filter((F.col("centre.doc_id") < F.col("last")) & F.col("indexed_any")).select("token", "centre")
    members = scratch.keep(tokens.join(shared, "token"), "members")

    # Stars: of the centres of like size the one that most tokens share.
    n, m = F.col("n"), F.col("centre.n")
    stars = members.filter((F.col("doc_id") != F.col("centre.doc_id")) & (100 * F.least(n, m) >= p.percent * F.greatest(n, m)))
    stars = stars.groupBy("doc_id", F.col("centre.doc_id").alias("centre")).agg(F.count("*").alias("votes"))
    best = stars.groupBy("doc_id").agg(F.min(F.struct((-F.col("votes")).alias("less"), "centre")).alias("best"))
    pairs = scratch.keep(best.select(F.col("best.centre").alias("a"), F.col("doc_id").alias("b")), "pairs")
    links = scratch.keep(confirmed(pairs, rows, p).distinct(), "links")
    parts = scratch.keep(components(links, scratch), "parts")
    scratch.drop("single", "pairs")

    open_rows = scratch.keep(open_buckets(members, parts), "open-buckets")
    scratch.drop("members")
    groups = scratch.keep(grouped(open_rows, p), "groups")
    queries = scratch.keep(queries_of_groups(open_rows, groups, p), "queries")
    groups = groups.join(queries.select("gid").distinct(), "gid", "left_semi")
    sought = queries.select("doc_id").union(groups.select("doc_id")).distinct()
    found = opened(queries, groups, token_sets(rows, sought, p), p)
    links = scratch.keep(links.union(found).distinct(), "all-links")
    scratch.drop("open-buckets", "groups", "queries")
    parts = scratch.keep(components(links, scratch, "all-stars"), "all-parts")

    found = signs.drop("prefix").join(classes, "digest", "left")
    found = found.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))
