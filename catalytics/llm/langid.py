"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features.  A text is lower-cased, every non-letter becomes one space, and its character 1- to
3-grams are hashed into ``2 ** feature_bits`` buckets; a bucket's value is (1 + ln count) * idf,
and the vector is scaled to length 1.  Document frequencies are counted over all training
documents.

Training.  The weights are fitted on a bounded sample: at most ``rows_per_language`` training
documents of each language, the ones with the smallest hash of the text.  Follow the regularised
leader (FTRL-proximal) makes ``epochs`` passes with an L1 and an L2 penalty, so most weights are
exactly zero.  One document in ``calibration_every`` of the sample is held back, and a temperature
is fitted to it by minimising the negative log-likelihood (golden-section search).

Prediction runs on every whole text.  Its n-grams are counted in pieces of ``PIECE`` characters that
carry the last letters on, so a long text has the counts of one piece.  Only the text is an input.

Special cases: a text that is null or has no letter gets ``und`` with score 0; without labelled
training rows every text does; repeated rows are separate rows; ties go to the language that sorts
first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames
from catalytics.llm.text import mix

UNKNOWN = "und"
PIECE = 1 << 18
_SPACE = 32


@dataclass(frozen=True)
class Settings:
    feature_bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    rows_per_language: int = 1000       # bound of the fitted sample
    calibration_every: int = 5
    epochs: int = 3
    alpha: float = 1.0                  # FTRL learning rate
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray                     # (features,)
    weights: np.ndarray                 # (features + 1, languages); the last row is the bias
    temperature: float
    settings: Settings


def _letters(low: str, after_letter: bool) -> tuple[np.ndarray, bool]:
    """Code points of a lower-cased piece, a run of other characters than letters as one space; whether it ends in a letter."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_letter = (codes >= 97) & (codes <= 122)
    letter = ascii_letter.copy()
    other = np.flatnonzero(~ascii_letter & (codes >= 128))
    if len(other):
        kinds, which = np.unique(codes[other], return_inverse=True)
        letter[other] = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[which]
    keep = letter.copy()
    keep[1:] |= letter[:-1]                               # the first non-letter after a letter
    keep[0] |= after_letter
    return np.where(letter, codes, _SPACE)[keep], bool(letter[-1])


def features(body: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts, over the whole text; nothing for a text without letters."""
    size = 1 << settings.feature_bits
    counts = np.zeros(size, np.int64)
    low, tail, after_letter, any_letter = body.lower(), np.zeros(0, np.uint64), False, False
    for at in range(0, len(low), PIECE):
        codes, after_letter = _letters(low[at:at + PIECE], after_letter)
        any_letter |= bool((codes != _SPACE).any())
        codes = codes.astype(np.uint64) if at else np.concatenate([[_SPACE], codes]).astype(np.uint64)
        for n in settings.orders:                         # grams that end in this piece
            run = np.concatenate([tail[len(tail) - n + 1:] if 1 < n <= len(tail) else tail[:0] if n == 1 else tail, codes])
            gram = np.zeros(max(0, len(run) - n + 1), np.uint64)
            for k in range(n):
                gram = gram * np.uint64(0x110000) + run[k:len(run) - n + 1 + k] if len(gram) else gram
            if len(gram):
                counts += np.bincount((mix(gram + np.uint64(n)) >> np.uint64(64 - settings.feature_bits)).astype(np.int64), minlength=size)
        tail = np.concatenate([tail, codes])[-max(1, max(settings.orders) - 1):]
    used = np.flatnonzero(counts) if any_letter else np.zeros(0, np.int64)
    return used, counts[used]


def _vector(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[used]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_languages: int, size: int, s: Settings) -> np.ndarray:
    """FTRL-proximal over sparse rows (indices, values); the bias is one more feature of value 1, free of L1."""
    z, n = np.zeros((size + 1, n_languages)), np.zeros((size + 1, n_languages))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        w[np.abs(z[i]) <= s.l1] = 0
        free = i == size
        w[free] = -z[i[free]] / ((s.beta + np.sqrt(n[i[free]])) / s.alpha + s.l2)
        return w

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for r in order.permutation(len(rows)):
            i, x = rows[r]
            w = weights(i)
            error = _softmax(x @ w)
            error[labels[r]] -= 1
            g = x[:, None] * error[None, :]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the smallest negative log-likelihood on held-back rows (golden section over its logarithm)."""
    if not len(labels):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequency_batches(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << settings.feature_bits, np.int64), 0
        for batch in batches:
            for x in batch.column("text"):
                used, _ = features(x.as_py(), settings)
                total[used] += 1
                n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], n))], ["feature", "n"])
    return run


def train(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", settings: Settings = Settings()) -> Model:
    """Fit on rows with a non-null text and language; every other column is ignored."""
    rows = labelled.select(labelled[text_column].cast("string").alias("text"), labelled[lang_column].cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    size = 1 << settings.feature_bits
    frequency = np.zeros(size + 1)
    for r in rows.select("text").mapInArrow(_frequency_batches(settings), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        frequency[r.feature] = r.n                        # at most one row per feature bucket
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    hashed = rows.select("lang", F.xxhash64("text", F.lit("sample")).alias("__h"))
    # the smallest hashes of a language lie under a share of all hashes that follows from their number: four times what is kept passes
    several = hashed.groupBy("lang").agg(F.approx_count_distinct("__h").alias("__n"))
    below = F.col("__h") <= F.least(F.lit(1.0), 4.0 * settings.rows_per_language / F.col("__n")) * 2.0 ** 64 - 2.0 ** 63
    rank = Window.partitionBy("lang").orderBy("__h")
    chosen = hashed.join(several, "lang").where(below).select("lang", "__h").distinct().withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= settings.rows_per_language)
    sample = rows.withColumn("__h", F.xxhash64("text", F.lit("sample"))).join(chosen.select("lang", "__h"), ["lang", "__h"]).mapInArrow(
        _sample_batches(settings), "lang string, h long, used binary, counts binary").dropDuplicates(["lang", "h"]).collect()
    sample.sort(key=lambda r: (r.h, r.lang))
    languages = sorted({r.lang for r in sample})
    data = []
    for r in sample:
        used, counts = np.frombuffer(r.used, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32)
        data.append((np.append(used, size), np.append(_vector(used, counts, idf), 1.0)))
    labels = np.array([languages.index(r.lang) for r in sample], int)
    held = np.arange(len(data)) % settings.calibration_every == settings.calibration_every - 1
    fit = np.flatnonzero(~held)
    weights = fit_ftrl([data[i] for i in fit], labels[fit], len(languages), size, settings) if languages else np.zeros((size + 1, 0))
    held = np.flatnonzero(held)
    logits = np.array([data[i][1] @ weights[data[i][0]] for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, fit_temperature(logits, labels[held]), settings)


def _sample_batches(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py(), settings) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("__h"), pa.array([u.astype(np.int32).tobytes() for u, _ in found], pa.binary()),
                 pa.array([np.minimum(c, 2**31 - 1).astype(np.int32).tobytes() for _, c in found], pa.binary())], ["lang", "h", "used", "counts"])
    return run


def _predict_batches(broadcast, id_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        for batch in batches:
            langs, scores = [], []
            for x in batch.column("__text"):
                used, counts = features(x.as_py() or "", model.settings)
                if not len(used) or not model.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax((_vector(used, counts, model.idf) @ model.weights[used] + model.weights[-1]) / model.temperature)
                langs.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in id_names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*id_names, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, keep: dict[str, Column], text_column: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score of every row; the model (bounded by its bucket count) is broadcast."""
    chosen = docs.select(*(c.alias(n) for n, c in keep.items()), docs[text_column].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return chosen.mapInArrow(_predict_batches(shared, list(keep)), f"{schema}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """Remainder by four of the crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    model = train(docs.where(fold(docs["doc_id"]) != 2))
    return predict(docs, model, {"doc_id": docs["doc_id"], "held_out": fold(docs["doc_id"]) == 2})
