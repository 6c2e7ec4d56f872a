"""Removal of word windows that occur more than once, behind a count-min prefilter.

Every window of `window` words is represented by an anchor: the smallest
hash among its `anchor` word shingles, the leftmost of equal ones. Equal
windows have equal anchors at equal places, so the number of places chosen
as an anchor of some window is an upper bound for the count of each of its
windows, and there are about `window - anchor` times fewer places than windows.

1. Each partition counts its anchor places in a count-min sketch (two rows,
   counters that stop at 2); the partition sketches are merged by block.
2. A second pass takes only the windows whose anchor is estimated at 2 or
   more. Equal windows of one chunk of text settle each other there and then
   and send one of them on, so a window that fills a third of all texts
   sends one row per chunk. The rest are grouped exactly by window; they travel
   by anchor and largest shingle, many windows of a text in one row.
3. Places of repeated windows go back to their text, which drops the words.

The estimate never falls below the count, so no repeated window is lost; a
sketch that is too small only lets more windows into the exact step. Its
width follows the number of words up to `max_cells` counters per row, which
bounds what is broadcast (2 * max_cells / 8 bytes). A window is identified by
64 bits of its words and 64 of its anchor.

Defined results
- null and empty texts have no words: nothing removed, the empty text is kept.
- repeated rows and equal texts repeat each other's windows; texts shorter
  than a window keep everything.
- empty table: no rows. A very long text is handled whole by one task.
- extra columns, whatever their names, do not matter: only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.llm.frames import only
from weekwise.llm.words import Texts, mix, sliding_min, texts, window_hashes

BLOCK = 1 << 16
CHUNK = 1_000_000  # bytes of text that one worker takes apart at a time
_PLACE_BITS = np.uint64(26)
_PLACE = np.uint64((1 << 26) - 1)


def anchors(t: Texts, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, place of each window's anchor, shingle hash at each place, word hashes."""
    h = t.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, np.uint64), h
    shingles = window_hashes(h, anchor)
    # Places have 26 bits: a longer text is cut into runs that share window - anchor shingles with the next one.
    span, n = window - anchor, len(h) - window + 1
    place, step = np.empty(n, np.int64), int(_PLACE) + 1 - span
    for a in range(0, n, step):
        run = shingles[a : a + step + span]
        # The place in the low bits makes the minimum the leftmost of those with equal high bits.
        ranked = (run & ~_PLACE) | np.arange(len(run), dtype=np.uint64)
        place[a : a + step] = (sliding_min(ranked, span + 1) & _PLACE).astype(np.int64) + a
    starts = np.flatnonzero(t.windows_from(window))
    return starts, place[starts], shingles, h


def cells(key: np.ndarray, width: int) -> list[np.ndarray]:
    """Counter of each key in either row of the sketch."""
    m = np.uint64(width - 1)
    return [(key >> np.uint64(8)) & m, ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & m]


def _distinct_places(place: np.ndarray) -> np.ndarray:
    """Places of ascending anchors, once each."""
    return place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place


def sketch(docs: DataFrame, width: int, window: int, anchor: int) -> list[bytes]:
    """The merged sketch: per row a bit for each counter that reached 2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[], []]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row, parts in enumerate(seen):
                if not parts:
                    continue
                cell, n = np.unique(np.concatenate(parts), return_counts=True)
                block = cell // np.uint64(BLOCK)
                cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(cell)]
                offset = (cell % np.uint64(BLOCK)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(cuts) - 1, row, np.int32)),
                        pa.array(block[cuts[:-1]].astype(np.int32)),
                        pa.array([offset[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                        pa.array([offset[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    ],
                    ["row", "block", "once", "twice"],
                )
                parts.clear()

        for batch in batches:
            for _, t in texts(batch.column(0), limit=CHUNK):
                _, place, shingles, _ = anchors(t, window, anchor)
                key = shingles[_distinct_places(place)]
                for parts, cell in zip(seen, cells(key, width)):
                    parts.append(cell)
                held += len(key)
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, once, twice in zip(*(batch.column(i).to_pylist() for i in range(4))):
                c = counters.setdefault((row, block), np.zeros(BLOCK, np.uint8))
                c[np.frombuffer(once, np.uint16)] += 1
                c[np.frombuffer(twice, np.uint16)] = 2
                np.minimum(c, 2, out=c)
        if counters:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counters], pa.int32()),
                    pa.array([k[1] for k in counters], pa.int32()),
                    pa.array([np.packbits(c == 2).tobytes() for c in counters.values()], pa.binary()),
                ],
                ["row", "block", "bits"],
            )

    parts = docs.select("text").mapInArrow(count, "row int, block int, once binary, twice binary")
    merged = parts.repartition("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    rows = [bytearray(max(width, BLOCK) // 8) for _ in range(2)]
    for row, block, bits in merged.toLocalIterator():  # at most 2 * width / BLOCK rows
        rows[row][block * BLOCK // 8 : (block + 1) * BLOCK // 8] = bits
    return [bytes(r) for r in rows]


def _bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    c = cell.astype(np.int64)
    return (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1


def _pack(rows: list[tuple[int, int]], ids, keys, place, start, found, flags, repeated) -> pa.RecordBatch:
    """A row per (route, text): window starts with, if they are still open, their hashes and flags."""
    route, which, a, b = rows
    return pa.RecordBatch.from_arrays(
        [
            pa.array(route, pa.int64()),
            ids.take(pa.array(which)),
            keys.take(pa.array(which)),
            pa.array([start[i:j].astype(np.int32).tobytes() for i, j in zip(a, b)], pa.binary()),
            pa.array([found[i:j].tobytes() if not repeated else b"" for i, j in zip(a, b)], pa.binary()),
            pa.array([flags[i:j].astype(np.uint8).tobytes() if not repeated else b"" for i, j in zip(a, b)], pa.binary()),
        ],
        ["route", "doc_id", "row_key", "starts", "hashes", "flags"],
    )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def repeated_windows(docs: DataFrame, bits: list[bytes], width: int, window: int, anchor: int) -> DataFrame:
    """(doc_id, row_key, starts): 32-bit starts of windows that occur again; a text may have several rows.

    `docs` has doc_id, row_key and text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.frombuffer(b, np.uint8) for b in shared.value]
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, t in texts(batch.column(2), limit=CHUNK):
                starts, place, shingles, h = anchors(t, window, anchor)
                if not len(starts):
                    continue
                key = shingles[place]
                a, b = cells(key, width)
                open_ = _bit(table[0], a) & _bit(table[1], b)
                starts, place, key = starts[open_], place[open_], key[open_]
                # Windows around a common passage share its anchor; their largest shingle tells most of them apart.
                largest = ~sliding_min(~shingles, window - anchor + 1)[starts]
                route = mix(key ^ mix(largest))
                if not len(starts):
                    continue
                found = window_hashes(h, window)[starts]
                order = np.argsort(found, kind="stable")
                same = found[order[1:]] == found[order[:-1]]
                again = np.zeros(len(found), bool)
                again[order[1:][same]] = True  # not the first of its kind in this chunk
                several = again.copy()
                several[order[:-1][same]] = True
                doc = np.searchsorted(t.first, starts, "right") - 1
                start = starts - t.first[doc]
                # Repeated for certain: straight to the text.
                if several.any():
                    s, d = start[several], doc[several]
                    i, j = _runs(d)
                    yield _pack((d[i], d[i] + lo, i, j), ids, keys, None, s, None, None, True)
                # One of each kind goes on, with word whether it was repeated.
                one = ~again
                s, d, p, r, f, m = start[one], doc[one], place[one], route[one], found[one], several[one]
                i, j = _runs(mix(p.astype(np.uint64)) ^ r)
                yield _pack((r[i].view(np.int64), d[i] + lo, i, j), ids, keys, None, s, f, m, False)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "row_key", "starts"], None
        held = []
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            sizes = np.array([len(x) for x in batch.column(4).to_pylist()])
            settled = sizes == 0
            if settled.any():
                mask = pa.array(settled)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (1, 2, 3)], names)
            if not settled.all():
                held.append(batch.filter(pa.array(~settled)))
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in rows:
            route = batch.column(0).to_numpy()
            starts = batch.column(3).to_pylist()
            lengths = np.array([len(x) // 4 for x in starts])
            start = np.frombuffer(b"".join(starts), np.int32)
            found = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64)
            flag = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8) > 0
            owner = np.repeat(np.arange(len(route)), lengths)
            order = np.lexsort((np.repeat(route, lengths), found))
            same = (found[order[1:]] == found[order[:-1]]) & (route[owner[order[1:]]] == route[owner[order[:-1]]])
            hit = np.zeros(len(found), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            hit &= ~flag  # those were settled in their chunk
            o, s = owner[hit], start[hit]
            i, j = _runs(o)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(o[i])),
                    batch.column(2).take(pa.array(o[i])),
                    pa.array([s[x:y].tobytes() for x, y in zip(i, j)], pa.binary()),
                ],
                names,
            )

    schema = f"route bigint, doc_id {id_type}, row_key bigint, starts binary, hashes binary, flags binary"
    open_rows = docs.select("doc_id", "row_key", "text").mapInArrow(candidates, schema)
    return open_rows.repartition("route").mapInArrow(settle, f"doc_id {id_type}, row_key bigint, starts binary")


def _kept_bytes(t: Texts, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text, joined by one space."""
    starts, lengths = t.starts[keep], (t.ends - t.starts)[keep] + 1
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if total:
        at = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        out = t.data[np.minimum(at, len(t.data) - 1)]
        out[ends - 1] = 32
    else:
        out = np.zeros(0, np.uint8)
    edge = np.r_[0, ends][np.searchsorted(np.flatnonzero(keep), t.first)]
    flat = out.tobytes()
    return [flat[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def removed_words(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    window: int = 35,
    anchor: int = 8,
    max_cells: int = 1 << 27,
    with_text: bool = True,
) -> DataFrame:
    """Per row: its id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    rows = only(docs, doc_id=id_column, text=text)
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    n_bytes = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # About one word in 6 bytes, one anchor in (window - anchor + 2) / 2 words, four counters an anchor.
    wanted = 4 * n_bytes // 6 * 2 // (window - anchor + 2)
    width = 1 << min(max(16, int(wanted).bit_length()), max_cells.bit_length() - 1)
    bits = sketch(rows, width, window, anchor)
    places = repeated_windows(rows, bits, width, window, anchor)
    places = places.groupBy("doc_id", "row_key").agg(F.collect_list("starts").alias("starts"))
    joined = rows.alias("r").join(
        places.alias("p"),
        (F.col("r.row_key") == F.col("p.row_key")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")),
        "left",
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, t in texts(batch.column(1), limit=CHUNK):
                n = len(t)
                gain = np.zeros(len(t.starts) + 1, np.int64)
                for i, parts in enumerate(batch.column(2).slice(lo, n).to_pylist()):
                    if parts:
                        start = np.frombuffer(b"".join(parts), np.int32) + t.first[i]
                        np.add.at(gain, start, 1)
                        np.add.at(gain, start + window, -1)
                keep = np.cumsum(gain[:-1]) == 0
                kept = _kept_bytes(t, keep)
                total = t.n_words
                left = np.diff(np.r_[0, np.cumsum(keep)][t.first])
                columns = [
                    batch.column(0).slice(lo, n),
                    pa.array(total, pa.int64()),
                    pa.array(total - left, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ]
                if with_text:
                    columns.append(pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))
                names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string"
    schema += ", kept_text string" if with_text else ""
    return joined.select("r.doc_id", "r.text", "p.starts").mapInArrow(finish, schema)
