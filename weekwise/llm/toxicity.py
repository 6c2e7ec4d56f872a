"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A bag holds the character 3- to 5-grams (hashed) of `span` consecutive
words; the mean of their embeddings goes through a two-class softmax. A
text scores as its most toxic bag, so one insult is not thinned out by a long
text. Embeddings and softmax weights are trained jointly in numpy: first
every bag takes its text's label, then only the bag that decides the text
(multiple-instance learning). A misspelt word shares n-grams with the words
it comes from, and letter lookalikes are folded, so it scores alike.

The model is fitted on a bounded sample (`per_label` rows of each label; rows
are bounded, not their bytes, so long labelled texts take more of the driver);
texts of the sample and of the scored table are read whole.

Defined results
- null, empty or letterless texts have no bag and score the softmax of the
  zero vector; without a row of either label every score is the share of
  toxic rows among the labelled ones (0 if there are none).
- labels: null ones are not used; a row labelled more than once counts as
  toxic if any of its labels says so. Label ids without a document do nothing.
- repeated rows score alike; extra columns do not matter; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekwise.llm.frames import only
from weekwise.llm.ngrams import Letters
from weekwise.llm.samples import fold, held_out, sample_ids
from weekwise.llm.words import Texts, texts

SIZES = (3, 4, 5)
PIECE = 16_384  # words whose n-grams are listed at a time


@dataclass(frozen=True)
class ModelParams:
    per_label: int = 960
    bucket_bits: int = 17
    dim: int = 8
    span: int = 3
    bag_steps: int = 40
    text_steps: int = 120
    rate: float = 0.05
    seed: int = 5


@dataclass
class Model:
    table: np.ndarray  # log odds that an n-gram's embedding adds: row 0 is zero
    bias: float
    bits: int
    span: int

    def scores(self, t: Texts) -> np.ndarray:
        """Per text: probability of its most toxic bag."""
        letters = Letters(t, lookalikes=True)
        total = np.zeros(len(letters.starts))
        count = np.zeros(len(letters.starts))
        for n in SIZES:
            value, found = _per_word(letters, n, self.bits, self.table)
            total += value
            count += found
        best = _best_bags(_bags(total, letters.first, self.span), _bags(count, letters.first, self.span), letters.first)
        return 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best), best, 0) + self.bias, -30, 30)))


def _per_word(letters: Letters, n: int, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table values and number of n-grams, per word."""
    bucket = letters.buckets(n, bits)
    if not len(letters.starts) or not len(bucket):
        return np.zeros(len(letters.starts)), np.zeros(len(letters.starts))
    # An n-gram may begin with the separator before its word.
    begin = np.minimum(np.maximum(letters.starts - 1, 0), len(bucket) - 1)
    begin[letters.starts == 0] = 0
    sums = np.add.reduceat(table[bucket], begin, dtype=np.float32).astype(float)
    found = np.add.reduceat(bucket > 0, begin, dtype=np.int64).astype(float)
    last = letters.starts - 1 >= len(bucket)
    sums[last] = found[last] = 0
    return sums, found


def _bags(values: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Sum over the `span` words from each word on, inside its text."""
    return _sums(values, _ends(first, span))


def _ends(first: np.ndarray, span: int) -> np.ndarray:
    """Place after the last word of the bag that starts at each word."""
    end = np.arange(first[-1])
    end += span
    return np.minimum(end, np.repeat(first[1:], np.diff(first)), out=end)


def _sums(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of the values from each place up to its end."""
    total = _running(values)
    found = total[end]
    found -= total[:-1]
    return found


def _running(values: np.ndarray) -> np.ndarray:
    """0 and the running sums, in one array."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total


def _best_bags(total: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest mean of any bag, per text; -inf where there is no bag."""
    out = np.full(len(first) - 1, -np.inf)
    some = first[1:] > first[:-1]
    if some.any():
        mean = np.where(count > 0, total / np.maximum(count, 1), 0.0)
        out[some] = np.maximum.reduceat(mean, first[:-1][some])
    return out


@dataclass
class _Sample:
    """Words of the sample: distinct ones with their n-grams, and the bags they form."""

    grams: np.ndarray  # buckets of the distinct words' n-grams, word after word
    cuts: np.ndarray  # distinct word i has grams[cuts[i]:cuts[i + 1]]
    word: np.ndarray  # distinct word at each place
    first: np.ndarray  # text i has places first[i] to first[i + 1]


def _pick(values: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs values[begin[i]:begin[i] + size[i]] of the chosen i, end to end."""
    own = size[which]
    cuts = np.r_[0, np.cumsum(own)]
    out = np.empty(cuts[-1], values.dtype)
    for i in range(0, len(which), PIECE):
        part = slice(i, i + PIECE)
        a, b = cuts[i], cuts[min(i + PIECE, len(which))]
        out[a:b] = values[np.arange(a, b) + np.repeat(begin[which[part]] - cuts[:-1][part], own[part])]
    return out


def _sample(bodies: list[str], bits: int) -> _Sample:
    """Read the sample a small chunk at a time, keeping n-grams of distinct words only."""
    keys, known, grams, sizes, firsts, at = [], [], [], [], [np.zeros(1, np.int64)], 0
    for _, t in texts(pa.array(bodies, pa.string()), limit=200_000):
        letters = Letters(t, lookalikes=True)
        # Words as the n-grams see them: hash of the folded bytes between separators.
        key = Texts(letters.codes, letters.offsets).hashes()
        starts = letters.starts
        owner = np.cumsum(np.bincount(np.maximum(starts - 1, 0), minlength=len(letters.codes))) - 1
        parts, who = [], []
        for n in SIZES:
            bucket = letters.buckets(n, bits)
            real = np.flatnonzero(bucket)
            parts.append(bucket[real].astype(np.int32))
            who.append(owner[real])
        who, parts = np.concatenate(who), np.concatenate(parts)
        parts = parts[np.argsort(who, kind="stable")]
        size = np.bincount(who, minlength=len(starts))
        distinct, where = np.unique(key, return_index=True)
        keys.append(key)
        known.append(distinct)
        sizes.append(size[where])
        grams.append(_pick(parts, np.r_[0, np.cumsum(size)], size, where))
        firsts.append(letters.first[1:] + at)
        at += len(starts)
    key, size, gram = np.concatenate(known), np.concatenate(sizes), np.concatenate(grams)
    distinct, where = np.unique(key, return_index=True)
    word = np.searchsorted(distinct, np.concatenate(keys))
    cuts = np.r_[0, np.cumsum(size[where])]
    return _Sample(_pick(gram, np.r_[0, np.cumsum(size)], size, where), cuts, word, np.concatenate(firsts))


class _Adam:
    def __init__(self, *shapes: tuple[int, ...]) -> None:
        self.m, self.v, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0

    def step(self, values: list[np.ndarray], gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(values, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def fit(bodies: list[str], toxic: np.ndarray, params: ModelParams = ModelParams()) -> Model:
    """Train embeddings and softmax weights on labelled texts of both labels."""
    s = _sample(bodies, params.bucket_bits)
    rng = np.random.default_rng(params.seed)
    size = 2**params.bucket_bits + 1
    seen = np.zeros(size, bool)
    seen[s.grams] = True
    used = np.flatnonzero(seen)
    gram = (np.cumsum(seen) - 1)[s.grams]
    s.grams = np.zeros(0, np.int32)  # read no more
    embedding = rng.normal(0, 0.3, (len(used), params.dim))
    weight = rng.normal(0, 0.3, params.dim)  # difference of the two classes' softmax weights
    bias = np.array([np.log((toxic.sum() + 1) / ((1 - toxic).sum() + 1))])
    n_words = len(s.word)
    text = np.repeat(np.arange(len(bodies), dtype=np.int32), np.diff(s.first))
    per_word = np.diff(s.cuts)
    end = _ends(s.first, params.span)
    counts = _sums(per_word[s.word].astype(float), end)
    np.maximum(counts, 1, out=counts)
    by_place = np.zeros(len(gram) + 1)  # a number for each n-gram of the distinct words, after a 0
    some = s.first[1:] > s.first[:-1]
    adam = _Adam(embedding.shape, weight.shape, bias.shape)

    def step(slope_of, rate: float) -> None:
        # The arrays are as long as the sample: they are written in place and let go of early.
        by_place[0] = 0
        np.take(embedding @ weight, gram, out=by_place[1:], mode="clip")
        np.cumsum(by_place[1:], out=by_place[1:])
        means = _sums(np.diff(by_place[s.cuts])[s.word], end)
        means /= counts
        means += bias[0]
        slope, free = slope_of(means)
        del means
        # Each word of a bag gets the bag's slope; sum per word, then per n-gram.
        gain = np.zeros(n_words + 1)
        share = slope / counts
        gain[:n_words] += share
        gain -= np.bincount(end, share, minlength=n_words + 1)
        del share
        np.cumsum(gain[:-1], out=gain[:-1])
        coefficient = np.bincount(s.word, gain[:-1], minlength=len(per_word))
        del gain
        for i in range(0, len(per_word), PIECE):
            a, b = s.cuts[i], s.cuts[min(i + PIECE, len(per_word))]
            by_place[1 + a : 1 + b] = np.repeat(coefficient[i : i + PIECE], per_word[i : i + PIECE])
        by_gram = np.bincount(gram, by_place[1:], minlength=len(used))
        adam.step(
            [embedding, weight, bias],
            [np.outer(by_gram, weight) + 1e-6 * embedding, embedding.T @ by_gram, np.array([slope.sum() + free])],
            rate,
        )

    bag_label, balance = toxic.astype(np.int8)[text], (1 / np.maximum(np.diff(s.first), 1) / len(bodies))[text]

    def every_bag(odds: np.ndarray):
        return (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - bag_label) * balance, 0.0

    def deciding_bag(odds: np.ndarray):
        top = np.maximum.reduceat(odds, s.first[:-1][some])
        chosen = np.flatnonzero(odds == np.repeat(top, np.diff(s.first)[some]))
        _, one = np.unique(text[chosen], return_index=True)
        chosen = chosen[one]
        slope = np.zeros(n_words)
        slope[chosen] = (1 / (1 + np.exp(-np.clip(odds[chosen], -30, 30))) - toxic[some]) / len(bodies)
        empty = (1 / (1 + np.exp(-bias[0])) - toxic[~some]).sum() / len(bodies)
        return slope, empty

    if n_words:
        for _ in range(params.bag_steps):
            step(every_bag, params.rate)
        adam = _Adam(embedding.shape, weight.shape, bias.shape)
        for i in range(params.text_steps):
            step(deciding_bag, params.rate * (1 - 0.8 * i / params.text_steps))
    table = np.zeros(size, np.float32)
    table[used] = embedding @ weight
    return Model(table, float(bias[0]), params.bucket_bits, params.span)


def train(docs: DataFrame, labels: DataFrame, params: ModelParams = ModelParams()) -> Model:
    """Fit on a bounded, hash-chosen sample of the labelled rows that are not held out."""
    marks = only(labels, doc_id="doc_id", toxic="toxic").filter((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sample_ids(marks, "toxic", params.per_label)
    # Bounded: at most per_label ids of each label.
    picked = only(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id")
    got = picked.groupBy("doc_id").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    got = got.sort_by("doc_id")
    toxic = (got.column("toxic").to_numpy() > 0).astype(int)
    if len(set(toxic.tolist())) < 2:
        share = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-12, 1 - 1e-12))
        return Model(np.zeros(2**params.bucket_bits + 1, np.float32), np.log(share / (1 - share)), params.bucket_bits, 1)
    return fit([text or "" for text in got.column("text").to_pylist()], toxic, params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` and `predicted`; columns of these names are replaced."""
    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = [c.lower() for c in names].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.scores(t) for _, t in texts(batch.column(at))]
            value = np.concatenate(values) if values else np.zeros(0)
            columns = [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])

    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*rows.schema.fields, *own])
    return rows.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Train and score every row: doc_id, held_out, score, predicted."""
    rows = only(docs, doc_id="doc_id", text="text")
    found = score(rows, train(docs, labels, params))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
