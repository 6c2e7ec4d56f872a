"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One binary n-gram classifier per bit
(naive Bayes log odds of hashed character 3- and 4-grams) predicts on which
side of the bit a text lies; its mean log odds over the text is the margin.
Decoding adds, per language, the logistic loss of all margins against the
language's bits, each bit weighted by how well it separated the training
rows, and takes the smallest loss. `score` is the winner's share of
exp(-loss) over all languages, with a temperature fitted on the training
rows; a text whose best two languages are closer than `ambiguous_gap` in
that share is flagged.

The model is fitted on a bounded sample, `per_language` rows of each
language (`ModelParams`), and is a few megabytes; all else covers every row.

Defined results
- null text, or none with a letter: `und`, score 0, not ambiguous.
- no row to learn from: every text is `und` with score 0.
- one language only: it is predicted with score 1.
- ties go to the language that comes first by code point.
- repeated rows are predicted alike; extra columns do not matter; empty
  table: no rows. Texts are read whole, a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekwise.llm.frames import only
from weekwise.llm.ngrams import Letters
from weekwise.llm.samples import fold, held_out, sample_ids
from weekwise.llm.words import Texts, texts

CHUNK = 1_000_000
#: Code points to learn from at a time, and n-gram sizes.
SIZES = (3, 4)


@dataclass(frozen=True)
class ModelParams:
    per_language: int = 800
    bucket_bits: int = 16
    smoothing: float = 0.5
    max_exhaustive: int = 7
    ambiguous_gap: float = 0.2


def codewords(n: int, max_exhaustive: int = 7) -> np.ndarray:
    """n rows of -1/+1 bits.

    Up to `max_exhaustive` languages get the exhaustive code, every split of
    the languages into two sides once. More get 15 log2(n) random balanced
    bits, the best of 50 draws by smallest distance between two rows.
    """
    if n <= max_exhaustive:
        masks = range(1, 2 ** (n - 1))
        return np.array([[1 if (2 * m >> i) & 1 else -1 for m in masks] for i in range(n)], np.int8).reshape(n, -1)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = np.array([rng.permutation(np.arange(n) % 2) * 2 - 1 for _ in range(int(15 * np.log2(n)))], np.int8).T
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(n, dtype=int) * n * 99
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    tables: list[np.ndarray]  # per n-gram size: 1 + buckets rows of one log odds per bit; row 0 is zero
    weights: np.ndarray  # per bit
    temperature: float
    bits: int

    def margins(self, t: Texts) -> np.ndarray:
        """Texts x bits: mean log odds of the text's n-grams."""
        letters = Letters(t)
        total = np.zeros((len(t), self.code.shape[1]), np.float64)
        count = np.zeros(len(t), np.int64)
        for n, table in zip(SIZES, self.tables):
            bucket = np.zeros(len(letters.codes), np.int64)
            found = letters.buckets(n, self.bits)
            bucket[: len(found)] = found
            total += np.add.reduceat(table[bucket], letters.offsets[:-1], axis=0, dtype=np.float32)
            count += np.add.reduceat(bucket > 0, letters.offsets[:-1], dtype=np.int64)
        return total / np.maximum(count, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Texts x languages: weighted logistic loss against each codeword."""
        out = np.empty((len(margins), len(self.languages)))
        for i, word in enumerate(self.code):
            out[:, i] = np.logaddexp(0, -margins * word) @ self.weights
        return out

    def shares(self, margins: np.ndarray) -> np.ndarray:
        x = -self.losses(margins) * self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def fit(bodies: list[str], labels: list[str], params: ModelParams = ModelParams()) -> Model:
    """Fit the bit classifiers on labelled texts."""
    languages = sorted(set(labels))
    code = codewords(len(languages), params.max_exhaustive)
    at = {lang: i for i, lang in enumerate(languages)}
    counts = [np.zeros((len(languages), 2**params.bucket_bits)) for _ in SIZES]
    for lang in languages:
        mine = pa.array([b for b, x in zip(bodies, labels) if x == lang], pa.string())
        for _, t in texts(mine, limit=CHUNK):
            letters = Letters(t)
            for c, n in zip(counts, SIZES):
                bucket = letters.buckets(n, params.bucket_bits)
                c[at[lang]] += np.bincount(bucket, minlength=c.shape[1] + 1)[1:]
    tables = []
    for c in counts:
        rate = (c + params.smoothing) / (c.sum(axis=1, keepdims=True) + params.smoothing * c.shape[1])
        table = np.zeros((c.shape[1] + 1, code.shape[1]), np.float32)
        for b in range(code.shape[1]):
            one, other = rate[code[:, b] > 0].mean(axis=0), rate[code[:, b] < 0].mean(axis=0)
            table[1:, b] = np.log(one) - np.log(other)
        tables.append(table)
    model = Model(languages, code, tables, np.ones(code.shape[1]), 1.0, params.bucket_bits)
    if len(languages) == 1:
        return model

    truth = np.array([at[x] for x in labels])
    margins = np.concatenate([model.margins(t) for _, t in texts(pa.array(bodies, pa.string()), limit=CHUNK)])
    right = (margins * code[truth] > 0).mean(axis=0)
    model.weights = np.clip(np.log(np.clip(right, 0.05, 0.999) / (1 - np.clip(right, 0.05, 0.999))), 0.05, None)
    model.weights *= len(model.weights) / model.weights.sum()
    best = None
    for temperature in (0.25, 0.5, 1, 2, 4, 8, 16, 32):
        model.temperature = temperature
        likely = np.log(np.maximum(model.shares(margins)[np.arange(len(truth)), truth], 1e-12)).mean()
        if best is None or likely > best[0]:
            best = (likely, temperature)
    model.temperature = best[1]
    return model


def train(docs: DataFrame, params: ModelParams = ModelParams()) -> Model | None:
    """Fit on a bounded, hash-chosen sample of the rows that are not held out; null if there is none."""
    rows = only(docs, doc_id="doc_id", text="text", lang="lang")
    usable = rows.filter((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = sample_ids(usable.select("doc_id", "lang"), "lang", params.per_language)
    # Bounded: at most per_language ids of each language.
    picked = usable.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "lang")
    got = picked.toPandas()
    return fit(got["text"].tolist(), got["lang"].tolist(), params) if len(got) else None


def predict(docs: DataFrame, model: Model | None, params: ModelParams = ModelParams()) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""
    rows = only(docs, doc_id="doc_id", text="text").select(
        "doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, t in texts(batch.column(1), limit=CHUNK):
                n = len(t)
                lettered = batch.column(2).slice(lo, n).to_numpy(zero_copy_only=False)
                lang, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if m is not None and lettered.any():
                    shares = m.shares(m.margins(t))
                    best = shares.argmax(axis=1)
                    lang = np.where(lettered, np.array(m.languages, object)[best], "und")
                    top = np.sort(shares, axis=1)
                    gap = top[:, -1] - (top[:, -2] if shares.shape[1] > 1 else 0)
                    score = np.where(lettered, top[:, -1], 0.0)
                    close = lettered & (gap < params.ambiguous_gap)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(lang, pa.string()), pa.array(score), pa.array(close)],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, params: ModelParams = ModelParams()) -> DataFrame:
    """Train on `docs` and predict every row: doc_id, held_out, lang_pred, score, ambiguous."""
    found = predict(docs, train(docs, params), params)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
