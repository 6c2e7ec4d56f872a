"""Document fingerprints: a homomorphic multiset hash.

A paragraph (a line of the text) hashes to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power
of two. The sum does not depend on the paragraphs' order, and a paragraph
is inserted into or deleted from a fingerprint by adding or subtracting its
vector, without the rest of the text.

The vector has two parts. `exact`: four lanes modulo 2^64 that hash the whole
paragraph, for equality. `sketch`: lanes modulo 2^32 that count the signed
features of the paragraph (pairs of neighbouring words, and single words at
its ends, repeats within the paragraph told apart), so that inner products of two documents' sketches estimate how
many features they share; `likeness` is 2<a,b> / (<a,a> + <b,b>), cut to 0..1.

`edited_pairs` compares each text with a copy whose tail is replaced by the
start of the next document. Texts are dealt into blocks of neighbouring ids
that are bounded by quantiles, so a block meets one more document only: the
first one of the block after it.

Defined results
- null is the empty text: no paragraph, the zero fingerprint; two zero
  fingerprints have likeness 1, a zero and another one 0.
- equal texts have equal fingerprints, and so have texts with the same paragraphs in another order.
- a line feed ends its paragraph and is not part of it; what follows the last one is a paragraph if not empty. So
  "a" and "a\\n" are equal, an empty paragraph counts elsewhere ("a\\n\\nb") but not as the end of a text.
- repeated ids: rows follow each other in the order of id, then text; null ids come last.
- one row alone is its own next document. Empty table: no rows.
- extra columns do not matter. A very long text is hashed whole by one task;
  lanes wrap around, which is exact for equality.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.llm.frames import only
from weekwise.llm.words import Texts, mix, texts

EXACT = 4
LANES = 128
_EXACT_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


class Fingerprint:
    """`exact` and `sketch` lanes; + and - insert and delete the paragraphs of another fingerprint."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray | None = None, sketch: np.ndarray | None = None) -> None:
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.sketch = np.zeros(LANES, np.uint32) if sketch is None else sketch

    def __add__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: "Fingerprint") -> "Fingerprint":
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.text() == other.text()

    def text(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> "Fingerprint":
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, "<u8", EXACT).copy(), np.frombuffer(raw, "<u4", LANES, 8 * EXACT).copy())

    def likeness(self, other: "Fingerprint") -> float:
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        a, b = self.sketch.view(np.int32).astype(float), other.sketch.view(np.int32).astype(float)
        norm = a @ a + b @ b
        return float(min(1.0, max(0.0, 2 * (a @ b) / norm))) if norm else 0.0


def fingerprints(t: Texts) -> list[Fingerprint]:
    """Fingerprint of each text."""
    data, n = t.data, len(t)
    # Paragraphs: what lies between line feeds, hashed without the line feed.
    line_ends = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([t.offsets, line_ends]))
    owner = np.searchsorted(t.offsets, bounds[:-1], "right") - 1
    exact = np.zeros((n, EXACT), np.uint64)
    flat = data.tobytes()
    keys = np.array(
        [
            int.from_bytes(hashlib.blake2b(flat[a : b - (flat[b - 1] == 10)], digest_size=8).digest(), "little")
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
        ],
        np.uint64,
    )
    for lane, seed in enumerate(_EXACT_SEEDS):
        np.add.at(exact[:, lane], owner, mix(keys ^ seed))

    # Features: neighbouring words of one paragraph, and its first and last word.
    lines = Texts(data, bounds) if len(bounds) > 1 else Texts(data, np.zeros(1, np.int64))
    h = lines.hashes()
    sketch = np.zeros((n, LANES), np.int64)
    if len(h):
        first = lines.first
        line = np.repeat(np.arange(len(lines)), lines.n_words)
        inner = np.flatnonzero(line[1:] == line[:-1])
        some = np.flatnonzero(lines.n_words)
        feature = np.concatenate(
            [
                h[inner] * np.uint64(0xD6E8FEB86659FD93) + h[inner + 1],
                h[first[:-1][some]] + np.uint64(1),
                h[first[1:][some] - 1] + np.uint64(2),
            ]
        )
        where = np.concatenate([line[inner], some, some])
        doc = owner[where]
        # The n-th time in its paragraph a feature counts as one of its own: repeats add up, not their squares.
        key = mix(feature ^ mix(where.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        head = np.r_[True, key[order[1:]] != key[order[:-1]]]
        at = np.arange(len(key))
        nth = np.empty(len(key), np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(head, at, 0))
        feature = mix(feature + nth * np.uint64(0x9E3779B97F4A7C15))
        cell = doc * LANES + (feature >> np.uint64(40)).astype(np.int64) % LANES
        sign = ((feature & np.uint64(1)).astype(np.int64) * 2 - 1).astype(float)
        sketch = np.bincount(cell, sign, minlength=n * LANES).astype(np.int64).reshape(n, LANES)
    return [Fingerprint(exact[i], sketch[i].astype(np.uint32)) for i in range(n)]


def fingerprint(text: str) -> Fingerprint:
    """Fingerprint of one text; of one paragraph, the vector to insert or delete."""
    return next(fingerprints(t) for _, t in texts(pa.array([text], pa.string())))[0]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    rows = only(docs, doc_id="doc_id", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, t in texts(batch.column(1)):
                marks = [f.text() for f in fingerprints(t)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(t)), pa.array(marks, pa.string())], ["doc_id", "fingerprint"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited_pairs(docs: DataFrame, rows_per_block: int = 4096, share: int = 4, max_blocks: int = 2048) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text lacks the last floor(n_chars / share) code points and has
    as many (or all) of the next document's first ones instead. A block is
    streamed, so its size bounds no memory; `max_blocks` bounds their list.
    """
    rows = only(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    blocks = min(max_blocks, max(1, -(-n // rows_per_block)))
    # Block bounds: one id per block, whatever the texts' sizes.
    cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted({c for c in cuts or [] if c is not None})
    block = F.lit(0).cast("long")
    if cuts:
        # Number of bounds at or below the id: first which 64 of them, then where among those.
        groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
        group = _bisect([g[0] for g in groups[1:]])
        near = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), group)
        block = group * 64 + F.size(F.filter(near, lambda c: c <= F.col("doc_id")))
        block = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(block)
    placed = rows.withColumn("block", block)
    # The first row of each block is also the one after the last row of the block before it.
    heads = placed.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("h")).select("block", "h.doc_id").collect()
    order = sorted(r["block"] for r in heads)
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the first block's head follows the last block
    firsts = {r["block"]: r["doc_id"] for r in heads}
    spark = docs.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    head = spark.createDataFrame([(firsts[b], b, before[b]) for b in order], f"doc_id {kind}, block bigint, to bigint")
    follow = placed.join(F.broadcast(head), ["block"]).filter(head["doc_id"].eqNullSafe(placed["doc_id"]))
    follow = follow.select(placed["doc_id"], placed["text"], F.col("to").alias("block"), F.lit(True).alias("head"))
    both = placed.select("doc_id", "text", "block", F.lit(False).alias("head")).unionByName(follow)
    parts = min(blocks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = both.repartition(parts, "block").sortWithinPartitions(
        "block", "head", F.col("doc_id").asc_nulls_last(), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row so far: waits for the one after it
        for batch in batches:
            marks = [f for _, t in texts(batch.column(1)) for f in fingerprints(t)]
            bodies, where = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            is_head, names = batch.column(3).to_pylist(), batch.column(0)
            out: list[tuple] = []
            ready, edits = [], []
            for i, body in enumerate(bodies):
                # Of a block's tail rows (several if its id repeats) the first one counts.
                if held is not None and held[2] == where[i]:
                    ready.append((held, body, marks[i]))
                    held = None
                if not is_head[i]:
                    held = (names.slice(i, 1), body, where[i], marks[i])
            for (_, body, _, _), after, _ in ready:
                k = len(body) // share
                edits.append(body[: len(body) - k] + after[:k])
            changed = [f for _, t in texts(pa.array(edits, pa.string())) for f in fingerprints(t)]
            for (name, body, _, mark), (_, _, next_mark), edit, other in zip(
                (r[0] for r in ready), ready, edits, changed
            ):
                out.append(
                    (name, len(body), hashlib.sha256(edit.encode()).hexdigest(), mark.text(), other.text(),
                     mark.likeness(other), mark.likeness(next_mark))
                )
            if out:
                cols = list(zip(*out))
                arrays = [pa.concat_arrays(cols[0]), pa.array(cols[1], pa.int64())]
                arrays += [pa.array(c, pa.string()) for c in cols[2:5]] + [pa.array(c, pa.float64()) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays(arrays, COLUMNS)

    return sorted_rows.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _bisect(cuts: list) -> F.Column:
    """Number of sorted cuts at or below doc_id, as nested comparisons of logarithmic depth."""

    def part(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") >= F.lit(cuts[mid]), part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(cuts))
