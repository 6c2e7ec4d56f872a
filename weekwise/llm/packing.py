"""Packing token pieces into sequences: bounded-space best fit.

Every text becomes token ids plus one end id, cut into pieces of at most one
sequence; whole pieces are sequences of their own. The last, shorter pieces
are packed online: a task keeps `open_windows` open windows, places a piece
where the least room is left over, and emits the fullest window when none
fits. What is still open at the end of a group is merged with the leftovers
of up to `fan_in` other groups, the windows now being the pieces, level by
level, until one group is left; sizes alone travel, never tokens.

Groups are formed by hash of the piece (`leaf` of them each) and packed in
hash order, so the same rows give the same sequences, whatever the partitions.

Tokens are looked up stem by stem in a bounded cache: the tokenizer drops
white space and never joins across it, so a text's ids are its words' ids. The
distinct stems of a few texts are found at once, in Arrow.

Defined results
- null and empty texts are one piece that holds the end id alone.
- repeated rows are packed one by one; ties in size go to the older window.
- empty table: no rows. A very long text is tokenized by one task and is many
  whole pieces. Extra columns do not matter.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.llm.frames import only
from weekwise.llm.words import Texts, texts
from weekwise.session import Scratch

#: ASCII signs but the apostrophe, which the tokenizer may join with a letter after it.
SIGNS = string.punctuation.replace("'", "")


@dataclass(frozen=True)
class PackParams:
    tokenizer: str | None = None  # path of a tokenizers file that drops white space; None: the public word BPE
    end_id: int = 1
    length: int = 2048
    open_windows: int = 64
    leaf: int = 4096
    fan_in: int = 64
    cached_words: int = 500_000


_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in string.ascii_letters]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokenizer:
    """Token ids of texts, as little-endian 32-bit bytes, through a cache of stems.

    A word's stem and the signs after it are looked up apart, ASCII letters
    lowered, where the file's tokenizer lowers letters and keeps signs apart, which
    is tried out when it is loaded; else each word is a stem as it stands.
    """

    _loaded: dict[tuple[str, int], "WordTokenizer"] = {}

    def __init__(self, path: str, cached_words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.mark, self.mark_id = next((t.content, i) for i, t in added.items())
        self.limit, self.stems = cached_words, {}
        comma = self._ids([","])[0]
        self.comma = int(comma[0]) if len(comma) == 1 else None
        self.by_stem = self.comma is not None and self._keeps_signs_apart()

    def _keeps_signs_apart(self) -> bool:
        ends = [a + b for a in SIGNS for b in ["", *SIGNS]]
        asked = ["Stem", "stem", *ends, *["stem" + e for e in ends], "stem , stem"]
        capital, stem, *rest, pair = self._ids(asked)
        alone, joined = rest[: len(ends)], rest[len(ends) :]
        comma = np.array([self.comma], "<u4")
        return (
            np.array_equal(capital, stem)
            and np.array_equal(pair, np.r_[stem, comma, stem])
            and all(np.array_equal(j, np.r_[stem, a]) for a, j in zip(alone, joined))
        )

    @classmethod
    def load(cls, path: str | None, cached_words: int) -> "WordTokenizer":
        """One per Python worker and file."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if (path, cached_words) not in cls._loaded:
            cls._loaded[path, cached_words] = cls(path, cached_words)
        return cls._loaded[path, cached_words]

    def _ids(self, batch: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _many(self, stems: list[str], between: str, cut: int) -> None:
        """Add stems: one call for many of them, with a token between them that none of them has."""
        for lo in range(0, len(stems), 2000):
            part = stems[lo : lo + 2000]
            ids = self._ids([between.join(part)])[0]
            cuts = 4 * np.flatnonzero(ids == cut)
            flat = ids.tobytes()
            bounds = map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(flat)])
            self.stems.update(zip(part, map(flat.__getitem__, bounds)))

    def _learn(self, wanted: list[str]) -> None:
        """Add stems to the cache, which is emptied first if they do not fit."""
        new = [s for s in wanted if s not in self.stems]
        if len(self.stems) + len(new) > self.limit:
            self.stems.clear()
            new = wanted
        letters = [s for s in new if s.isascii() and s.isalpha()] if self.by_stem else []
        self._many(letters, " , ", self.comma)
        others = list(set(new).difference(letters))
        if any(m in x for x in ["\n".join(others), "\n".join(others).lower()] for m in self.marks):
            odd = [s for s in others if any(m in x for x in (s, s.lower()) for m in self.marks)]
            self.stems.update((s, self._ids([s])[0].tobytes()) for s in odd)
            others = list(set(others).difference(odd))
        self._many(others, self.mark, self.mark_id)

    def _stems_of(self, t: Texts) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Number of each stem, the distinct stems, and the first stem of each text and the end."""
        data, starts, ends = t.data, t.starts, t.ends
        cuts = starts[:0]
        if self.by_stem and len(starts):
            whole = np.zeros(len(starts), bool)  # words that stay as they are
            lowered = _LOWER[data].tobytes()
            for mark in {m.lower().encode() for m in self.marks}:
                at = lowered.find(mark)
                while at >= 0:
                    whole[np.searchsorted(starts, at, "right") - 1] = True
                    at = lowered.find(mark, at + 1)
            wide = np.add.reduceat(data >= 128, starts) > 0
            # The first of the signs that end a word, if a letter stands before it.
            at = np.flatnonzero(~_SIGN[data])
            last = at[np.maximum(np.searchsorted(at, ends) - 1, 0)] if len(at) else starts - 1
            some = last >= starts
            end, before = data[np.maximum(last, 0)], data[np.maximum(last - 1, 0)]
            latin = (end >= 128) & (before == 0xC3) & (end != 0x97) & (end != 0xB7) & (last > starts)
            cut = some & (last + 1 < ends) & ~whole & (_LETTER[end] | latin)
            cuts = last[cut] + 1
            # Lowering is left to the tokenizer beyond ASCII, where it could undo or make a composed letter.
            plain = np.repeat(~wide & ~whole, ends - starts)
            inside = np.repeat(starts, ends - starts) + _within(ends - starts)
            body = data[inside]
            body[plain] = _LOWER[body[plain]]
        else:
            body = data[np.repeat(starts, ends - starts) + _within(ends - starts)]
        bounds = np.sort(np.concatenate([starts, cuts]))
        skipped = np.r_[0, np.cumsum(starts[1:] - ends[:-1])] + (starts[0] if len(starts) else 0)
        at = bounds - skipped[np.searchsorted(starts, bounds, "right") - 1] if len(starts) else bounds
        offsets = np.r_[at, len(body)].astype(np.int64)
        stems = pa.Array.from_buffers(pa.large_string(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        coded = stems.dictionary_encode()
        return coded.indices, coded.dictionary, np.searchsorted(bounds, t.offsets)

    def encode_texts(self, t: Texts) -> tuple[bytes, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin and the last one's end."""
        codes, stems, first = self._stems_of(t)
        wanted = stems.to_pylist()
        self._learn(wanted)
        ids = pa.array(list(map(self.stems.__getitem__, wanted)), pa.large_binary()).take(codes)
        if not len(ids):
            return b"", np.zeros(len(first), np.int64)
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), offsets[first]

    def encode(self, bodies: list[str]) -> list[bytes]:
        out = []
        for _, t in texts(pa.array(bodies, pa.string())):
            flat, at = self.encode_texts(t)
            out += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return out


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of the given lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def pieces(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    width, end = 4 * p.length, np.array([p.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(p.tokenizer, p.cached_words)
        for batch in batches:
            for lo, t in texts(batch.column(1)):
                which, start, length, crc, total = [], [], [], [], []
                flat, bounds = tokenizer.encode_texts(t)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    ids = flat[a:b] + end
                    for at in range(0, len(ids), width):
                        cut = ids[at : at + width]
                        which.append(lo + i)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        total.append(len(ids) // 4)
                columns = [batch.column(0).take(pa.array(which, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = only(docs, doc_id="doc_id", text="text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def place(lengths: list[int], capacity: int, open_windows: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Window and offset of each length in the order given, and the fill of the windows still open at the end."""
    window, offset = [], []
    room: list[tuple[int, int]] = []  # (room left, window), ascending
    fill: dict[int, int] = {}
    n = 0
    for size in lengths:
        at = bisect_left(room, (size, -1))
        if size == capacity:
            w = n
            n += 1
            fill[w] = 0
        elif at < len(room):
            _, w = room.pop(at)
        else:
            if len(room) == open_windows:
                del fill[room.pop(0)[1]]  # the fullest: emitted
            w = n
            n += 1
            fill[w] = 0
        window.append(w)
        offset.append(fill[w])
        fill[w] += size
        if fill[w] == capacity:
            del fill[w]
        else:
            insort(room, (capacity - fill[w], w))
    return window, offset, fill


_WINDOW_BITS = 24


def _pack_level(rows: DataFrame, level: int, p: PackParams) -> DataFrame:
    """Pack rows (bucket, buckets, item order, length) inside their bucket.

    Adds `window` (unique over levels and buckets), `offset` in it, and `fill`,
    the window's length if it stays open for the next level, else null.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy() for c in ("length", "tie", "h")])
        table = table.take(pa.array(order))
        last = table.column("buckets")[0].as_py() == 1
        window, offset, open_ = place(table.column("length").to_pylist(), p.length, p.open_windows)
        base = (level << 56) | (table.column("bucket")[0].as_py() << _WINDOW_BITS)
        fill = [None if last else open_.get(w) for w in window]
        for name, values in (("window", [base + w for w in window]), ("offset", offset), ("fill", fill)):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("bucket").applyInArrow(run, f"{names}, window bigint, offset bigint, fill bigint")


def pack(docs: DataFrame, p: PackParams = PackParams(), scratch: Scratch | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = scratch or Scratch(docs.sparkSession)
    cut = scratch.keep(pieces(docs, p), "pieces")
    buckets = max(1, -(-cut.count() // p.leaf))
    h = F.xxhash64(F.col("doc_id").cast("string"), "start", "ids_crc32")
    rows = cut.withColumns({"h": h, "tie": F.lit(0).cast("long"), "buckets": F.lit(buckets).cast("long")})
    rows = rows.withColumn("bucket", F.pmod("h", "buckets"))
    packed = scratch.keep(_pack_level(rows, 0, p), "packed-0")
    scratch.drop("pieces")

    # (window, into, at): where a window that stayed open went.
    level, moved = 0, []
    left = packed.filter(F.col("fill").isNotNull()).select("window", "fill", "bucket", "buckets").distinct()
    while buckets > 1:
        level += 1
        buckets = -(-buckets // p.fan_in)
        rows = left.select(
            F.col("window").alias("tie"),
            F.xxhash64("window").alias("h"),
            F.col("fill").alias("length"),
            F.floor(F.col("bucket") / p.fan_in).alias("bucket"),
            F.lit(buckets).cast("long").alias("buckets"),
        )
        merged = scratch.keep(_pack_level(rows, level, p), f"packed-{level}")
        moved.append(merged.select(F.col("tie").alias("window"), F.col("window").alias("into"), F.col("offset").alias("at")))
        left = merged.filter(F.col("fill").isNotNull()).select("window", "fill", "bucket", "buckets").distinct()

    out = packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")
    for step in moved:
        out = out.join(step, "window", "left").select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.coalesce("into", "window").alias("window"),
            (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"),
        )
    return out.withColumnRenamed("window", "sequence_id")
