"""Phrase collocations: multikey three-way quicksort of suffix pointers, routed by leading words.

Texts are cut into pieces at sentence signs and line ends, pieces into
words. A suffix is what starts at a word and ends with its piece, five words
at most. Counts are per language.

1. One pass counts words, and one the hashes of neighbouring pairs of frequent
   words, first inside a chunk of text, then globally. Frequent words, then
   frequent hashes fill a table of `cells` counters, the only thing that is
   broadcast.
2. A third pass counts the pairs that the table lets through, and a fourth takes
   the suffixes of three words or more whose pairs are all frequent; equal ones
   of a chunk travel as one row with a weight, to the task of their two
   leading words. A pair with more than `run` occurrences is dealt to as many
   tasks as it needs, by the rest of the suffix.
3. There the pointers of a run of suffixes are sorted by three-way quicksort, word
   by word: pointers below, equal to and above the pivot's word; the equal
   ones go on with the next word. Their total weight is the count of the phrase read so
   far; partitions below the threshold are abandoned. A pair that was dealt
   to several tasks keeps small partitions of up to four words, and
   their counts are added afterwards.
4. Scores, cuts and the dropping of contained phrases are joins between
   tables of frequent phrases.

A hash or cell that several words or pairs share only lets more through or
deals it to more tasks; counts are exact. A task holds one run at a time, with equal
suffixes folded whenever it grows.

Defined results
- null and empty texts have no words; a null language counts as `und`.
- repeated rows count each time. Empty table: no rows.
- ties have fixed keys: score and count descending, phrase ascending by bytes.
- extra columns, whatever their names, do not matter: only text and language are read.
- a very long text is handled whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekwise.llm.frames import only
from weekwise.llm.words import Texts, mix, texts
from weekwise.session import Scratch


@dataclass(frozen=True)
class PhraseParams:
    longest: int = 5
    least: int = 100
    absorb_percent: int = 100
    top: int = 2000
    run: int = 1 << 20
    cells: int = 1 << 20  # a power of two


CHUNK = 2_000_000
FOLD_ROWS = 1 << 18
SMALL = 32  # pointers below which a partition is finished by a plain sort
SALTS = 32

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Pieces:
    """Words of a few texts."""

    codes: np.ndarray  # number of each word in `vocabulary`
    vocabulary: pa.Array
    text: np.ndarray  # number of its text
    joined: np.ndarray  # whether the next word follows in the same piece


def pieces(t: Texts) -> Pieces:
    data = np.insert(t.data, t.offsets[1:], 10)
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    piece = np.cumsum(kind == 2)[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    text = np.searchsorted(t.offsets[1:] + np.arange(len(t)), starts)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    kept = [None, pa.py_buffer(at), pa.py_buffer(data[inside])]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), kept).dictionary_encode()
    return Pieces(words.indices.to_numpy().astype(np.int64), words.dictionary, text, joined)


def distinct(columns: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of one of each distinct tuple, and how many there are; values are in [-1, top)."""
    bits = int(top + 1).bit_length()
    width = max(1, 63 // bits)
    keys = []
    for i in range(0, len(columns), width):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[i : i + width]:
            key = (key << bits) | (c + 1)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    cuts = np.flatnonzero(new)
    return order[cuts], np.diff(np.r_[cuts, len(order)])


def _langs(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.cast(pa.string()).fill_null("und").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _lang_hashes(names: pa.Array) -> np.ndarray:
    digests = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in names.to_pylist()]
    return np.frombuffer(b"".join(digests), np.uint64)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """Hash of each word of each string; the strings have no white space but single spaces."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0]).hashes()


def _keys(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Hash of a word or of a pair of words in a language."""
    return mix(lang + sum(h * factor for h, factor in zip(words, (_FIRST, _SECOND))))


def _at(key: np.ndarray, cells: int) -> np.ndarray:
    return (key & np.uint64(cells - 1)).astype(np.int64)


def _phrase(vocabulary: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """Words of each row joined by one space; -1 is no word."""
    parts = [vocabulary.take(pa.array(c, mask=c < 0)) for c in columns]
    if len(parts) > 1:
        parts = [pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type), null_handling="skip")]
    return parts[0].cast(pa.string())


def counted_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, n) of frequent words, and per language a row of 0 words that counts all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, names = _langs(batch.column(0))
            for lo, t in texts(batch.column(1), lower=True, limit=CHUNK):
                w = pieces(t)
                lang, top = codes[lo + w.text], max(len(w.vocabulary), len(names))
                for columns in ([], [w.codes]):
                    one, n = distinct([lang, *columns], top)
                    phrase = _phrase(w.vocabulary, [c[one] for c in columns]) if columns else pa.array([""] * len(one))
                    rows = [names.take(pa.array(lang[one])), phrase, np.full(len(one), len(columns), np.int32), n]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["lang", "phrase", "words", "n"])

    rows = docs.mapInArrow(count, "lang string, phrase string, words int, n bigint")
    total = rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= least) | (F.col("words") == 0))


def word_keys(words: DataFrame) -> DataFrame:
    """(key, n) of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, names = _langs(batch.column(0))
            key = _keys([_word_hashes(batch.column(1))], _lang_hashes(names)[codes])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2)], ["key", "n"])

    return words.filter("words = 1").select("lang", "phrase", "n").mapInArrow(run, "key bigint, n bigint")


def pair_keys(docs: DataFrame, frequent_words: np.ndarray, p: PhraseParams) -> DataFrame:
    """(key, n) of frequent pairs, told apart by 64 bits."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words.tobytes())
    cells = p.cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint16)
        for batch in batches:
            codes, names = _langs(batch.column(0))
            salt = _lang_hashes(names)
            for lo, t in texts(batch.column(1), lower=True, limit=CHUNK):
                w = pieces(t)
                h, lang = _word_hashes(w.vocabulary)[w.codes], salt[codes[lo + w.text]]
                often = table[_at(_keys([h], lang), cells)] > 0
                at = np.flatnonzero(w.joined[:-1] & often[:-1] & often[1:])
                key, n = np.unique(_keys([h[at], h[at + 1]], lang[at]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    total = docs.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= p.least)


def table_of(keys: DataFrame, p: PhraseParams) -> np.ndarray:
    """Per cell: 0 if no key falls there, else the number of tasks that its occurrences are dealt to."""
    at = F.col("key").bitwiseAND(F.lit(p.cells - 1))
    sums = keys.groupBy(at.alias("cell")).agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(p.cells, np.uint16)  # at most `cells` rows came
    table[sums["cell"].to_numpy(np.int64)] = np.minimum(-(-sums["n"].to_numpy(np.int64) // p.run), 65535)
    return table


def counted_pairs(docs: DataFrame, table: np.ndarray, p: PhraseParams) -> DataFrame:
    """(lang, phrase, words, n) of frequent pairs; only those that the table lets through leave their chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    cells = p.cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint16)
        for batch in batches:
            codes, names = _langs(batch.column(0))
            salt = _lang_hashes(names)
            for lo, t in texts(batch.column(1), lower=True, limit=CHUNK):
                w = pieces(t)
                h, lang = _word_hashes(w.vocabulary)[w.codes], codes[lo + w.text]
                at = np.flatnonzero(w.joined[:-1])
                at = at[table[_at(_keys([h[at], h[at + 1]], salt[lang[at]]), cells)] > 0]
                one, n = distinct([lang[at], w.codes[at], w.codes[at + 1]], max(len(w.vocabulary), len(names)))
                at = at[one]
                phrase = _phrase(w.vocabulary, [w.codes[at], w.codes[at + 1]])
                rows = [names.take(pa.array(lang[at])), phrase, np.full(len(at), 2, np.int32), n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["lang", "phrase", "words", "n"])

    rows = docs.mapInArrow(count, "lang string, phrase string, words int, n bigint")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least)


def suffixes(docs: DataFrame, table: np.ndarray, p: PhraseParams) -> DataFrame:
    """(route, lang, phrase, partial, weight): distinct suffixes of three words or more, per chunk of text."""
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    cells, longest = p.cells, p.longest

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = np.frombuffer(shared.value, np.uint16)
        for batch in batches:
            codes, names = _langs(batch.column(0))
            salt = _lang_hashes(names)
            for lo, t in texts(batch.column(1), lower=True, limit=CHUNK):
                w = pieces(t)
                if not len(w.codes):
                    continue
                h, lang = _word_hashes(w.vocabulary)[w.codes], codes[lo + w.text]
                pair = _keys([h, np.r_[h[1:], h[:1]]], salt[lang])
                tasks = dealt[_at(pair, cells)]
                alive = w.joined & (tasks > 0)
                length, run = np.ones(len(alive), np.int64), np.ones(len(alive), bool)
                for k in range(longest - 1):
                    run = run & np.r_[alive[k:], np.zeros(k, bool)]
                    length += run
                at = np.flatnonzero(length >= 3)
                end = at + length[at]
                columns = [np.where(at + k < end, w.codes[np.minimum(at + k, len(w.codes) - 1)], -1) for k in range(longest)]
                one, n = distinct([lang[at], *columns], max(len(w.vocabulary), len(names)))
                at, columns = at[one], [c[one] for c in columns]
                rest = np.zeros(len(at), np.uint64)
                for k, c in enumerate(columns[2:]):
                    rest = mix(rest + np.where(c < 0, np.uint64(k), h[np.minimum(at + k + 2, len(h) - 1)]))
                several = tasks[at] > 1
                part = np.where(several, rest % np.maximum(tasks[at], 1).astype(np.uint64), np.uint64(0))
                rows = [mix(pair[at] + part).view(np.int64), names.take(pa.array(lang[at])), _phrase(w.vocabulary, columns), several, n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["route", "lang", "phrase", "partial", "weight"])

    return docs.mapInArrow(emit, "route bigint, lang string, phrase string, partial boolean, weight bigint")


def quicksort(columns: list[np.ndarray], weight: np.ndarray, least: int, partial: bool) -> list[tuple[int, int, int]]:
    """(a row, words, count) of each phrase of three words or more with enough weight.

    `columns` are language and words as numbers, -1 for none. Each partition is (pointers, number of leading
    columns they agree on). With `partial`, only full-length phrases are judged by weight.
    """
    found: list[tuple[int, int, int]] = []
    last = len(columns) - 1
    todo = [(np.arange(len(weight)), 0)]
    while todo:
        at, depth = todo.pop()
        if not len(at) or (not partial and weight[at].sum() < least):
            continue
        if len(at) <= SMALL:
            found += _plain(columns, weight, at, depth, least, partial)
            continue
        key = columns[depth][at]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        same = key == pivot
        todo += [(at[key < pivot], depth), (at[key > pivot], depth)]
        equal = at[same]
        if pivot < 0:
            continue
        count = int(weight[equal].sum())
        if depth >= 3 and (count >= least or (partial and depth < last)):
            found.append((int(equal[0]), depth, count))
        if depth < last and (count >= least or partial):
            todo.append((equal, depth + 1))
    return found


def _plain(columns, weight, at, depth, least, partial) -> Iterator[tuple[int, int, int]]:
    """The phrases of a small partition."""
    last = len(columns) - 1
    groups: dict[tuple[int, ...], list[int]] = {}
    for row, w, *key in zip(at.tolist(), weight[at].tolist(), *(c[at].tolist() for c in columns[depth:])):
        for k, code in enumerate(key):
            if code < 0:
                break
            if depth + k >= 3:
                groups.setdefault(tuple(key[: k + 1]), [row, depth + k, 0])[2] += w
    for row, words, count in groups.values():
        if count >= least or (partial and words < last):
            yield row, words, count


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by route, in tables that hold all rows of their routes."""
    keys = ["route", "lang", "phrase", "partial"]
    held: list[pa.RecordBatch] = []
    rows = folded = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        route = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != route[0]:
            yield pa.Table.from_batches(held)
            held, rows, folded = [], 0, 0
        first_of_last = int(np.searchsorted(route, route[-1]))
        if first_of_last:
            yield pa.Table.from_batches([*held, batch.slice(0, first_of_last)])
            held, rows, folded = [], 0, 0
        held.append(batch.slice(first_of_last))
        rows += batch.num_rows - first_of_last
        if rows > 2 * folded + FOLD_ROWS:
            total = pa.Table.from_batches(held).group_by(keys).aggregate([("weight", "sum")])
            total = total.rename_columns([*keys, "weight"]).select(held[0].schema.names).cast(held[0].schema)
            held = total.combine_chunks().to_batches()
            rows = folded = total.num_rows
    if held:
        yield pa.Table.from_batches(held)


def mined(rows: DataFrame, p: PhraseParams) -> DataFrame:
    """(lang, phrase, words, n) of all frequent phrases of three words or more."""
    least, longest = p.least, p.longest

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            for partial in (False, True):
                part = table.filter(pc.equal(table.column("partial"), partial)).combine_chunks()
                if not part.num_rows:
                    continue
                lang, names = _langs(part.column("lang").combine_chunks())
                split = pc.split_pattern(part.column("phrase").combine_chunks().cast(pa.large_string()), " ")
                coded = split.flatten().dictionary_encode()
                codes, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
                start, length = offsets[:-1] - offsets[0], np.diff(offsets)
                columns = [
                    np.where(length > k, codes[np.minimum(start + k, len(codes) - 1)], -1) for k in range(longest)
                ]
                found = quicksort([lang, *columns], part.column("weight").to_numpy(), least, partial)
                for words in range(3, longest + 1):
                    some = [(row, n) for row, k, n in found if k == words]
                    if some:
                        at = np.array([row for row, _ in some])
                        out = [
                            names.take(pa.array(lang[at])),
                            _phrase(coded.dictionary, [c[at] for c in columns[:words]]),
                            pa.array(np.full(len(at), words, np.int32)),
                            pa.array([n for _, n in some], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(out, ["lang", "phrase", "words", "n"])

    dealt = rows.repartition("route").sortWithinPartitions("route")
    counts = dealt.mapInArrow(mine, "lang string, phrase string, words int, n bigint")
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent_phrases(docs: DataFrame, p: PhraseParams = PhraseParams(), scratch: Scratch | None = None) -> DataFrame:
    """(lang, phrase, words, n): phrases of up to `longest` words with at least `least` occurrences.

    A row of 0 words per language has the number of all its words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = only(docs, lang="lang", text="text")
    words = scratch.keep(counted_words(rows, p.least), "words")
    scratch.release()
    table = table_of(pair_keys(rows, table_of(word_keys(words), p), p), p)
    scratch.release()
    pairs = scratch.keep(counted_pairs(rows, table, p), "pairs")
    scratch.release()
    return words.union(pairs).union(scratch.keep(mined(suffixes(rows, table, p), p), "longer"))


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams(), scratch: Scratch | None = None) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 words or more is cut once; l and r count the parts of the cut with the lowest score
    floor(1000 * a * n / (l * r)). Scores are decimal arithmetic without fractions. Phrases that a longer one
    contains in `absorb_percent` of their occurrences are left out.
    """
    phrases = frequent_phrases(docs, p, scratch)
    total = phrases.filter("words = 0").select("lang", F.col("n").alias("n_all"))
    phrases = phrases.filter("words > 0")
    split = F.split("phrase", " ")
    longer = phrases.filter("words > 2").withColumn("w", split)
    inside = F.array(F.array_join(F.expr("slice(w, 1, words - 1)"), " "), F.array_join(F.expr("slice(w, 2, words - 1)"), " "))
    inside = longer.select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("most"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    found = phrases.filter("words > 1").join(inside, ["lang", "phrase"], "left")
    found = found.filter(F.coalesce(100 * F.col("most") < p.absorb_percent * F.col("n"), F.lit(True)))

    cuts = found.withColumn("w", split).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        "k",
        F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    score = F.expr(
        "cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n_all as decimal(17,0))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a", "n_all").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("n_all").alias("n"), "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # A limit per (language, salt) first, so that no task sees all phrases of a language.
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= p.top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= p.top).withColumn("rank", F.col("rank").cast("long"))
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
