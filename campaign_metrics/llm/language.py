"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the counts of character 1- to ``GRAMS``-grams are
hashed into ``BUCKETS`` features: (1 + log count) * idf, scaled to length one. Document frequencies come from all
training documents (summed per task, then by bucket: at most ``BUCKETS`` rows reach the driver). The weights are
learned by follow-the-regularised-leader (FTRL-proximal) steps with elastic-net penalties, L1 keeping them sparse,
on a sample of at most ``SAMPLE`` training documents, as many of every language that has them, the same in every run; a
fifth of it is held back to choose the temperature that calibrates the probabilities.
The model (at most ``BUCKETS`` x ``LANGUAGES`` numbers) is broadcast.

Training rows are those with a letter in the text, a non-null lang and crc32(doc_id as text) mod 4 other than ``HELD_OUT``. A
prediction looks at the text alone.

Defined cases: null text or a text without letters is ``und`` with score 0, as is every text when nothing was
learned; with one language learned every text with a letter gets it with score 1; equal scores go to the language
first in order; a row with a null id is neither held out nor learned from; repeated rows are predicted row by row; an
empty table gives an empty result. More languages than ``LANGUAGES`` are an error, since they would break the bound
of the broadcast. Texts of any length are counted in blocks of ``BLOCK`` characters, n-grams across blocks included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14
GRAMS = 3
BLOCK = 1 << 20
FOLDS, HELD_OUT = 4, 2
SAMPLE = 4_000
LANGUAGES = 500
UNKNOWN = "und"
PLACES = 1 << 40  # hashes by which rows are sampled

_SAMPLED = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("found", pa.binary()), ("counts", pa.binary())])

_SHIFT = np.uint32(33 - BUCKETS.bit_length())
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))  # odd multipliers, one per gram length


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the n-grams of a whole text; empty without a letter."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    lettered, carry = False, np.full(1, 32, dtype=np.uint32)
    text = text or ""
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at:at + BLOCK].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = _letters()[codes]
        lettered = lettered or bool((codes != 32).any())
        codes = np.r_[carry, codes]
        if at + BLOCK >= len(text):
            codes = np.r_[codes, np.full(1, 32, dtype=np.uint32)]
        grams = codes
        for n in range(1, GRAMS + 1):
            if n > 1:
                grams = grams[:-1] * np.uint32(0x01000193) + codes[n - 1:]
            fresh = grams[max(0, len(carry) - n + 1):] if at else grams  # grams inside the carry were counted before
            counts += np.bincount((fresh * _MIX[n - 1]) >> _SHIFT, minlength=BUCKETS)
        carry = codes[-(GRAMS - 1):]
    if not lettered:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of length one for the counted buckets."""
    x = (1 + np.log(counts)) * idf[found]
    return x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(found, counts, self.idf) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = gram_counts(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(min(1.0, p[best]))


def ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: int, buckets: int = BUCKETS,
         epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal steps, one sample (buckets, values) at a time; only the bias has no L1."""
    z, n = np.zeros((buckets + 1, languages)), np.zeros((buckets + 1, languages))

    def solve(z, n, l1):
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    penalty = np.full((buckets + 1, 1), l1)
    penalty[buckets] = 0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            rows, x = np.r_[samples[i][0], buckets], np.r_[samples[i][1], 1.0][:, None]
            zr, nr = z[rows], n[rows]
            w = solve(zr, nr, penalty[rows])
            error = softmax((x * w).sum(axis=0))
            error[labels[i]] -= 1
            g = x * error
            squares = g * g
            z[rows] = zr + g - (np.sqrt(nr + squares) - np.sqrt(nr)) / alpha * w
            n[rows] = nr + squares
    w = solve(z, n, penalty)
    return w[:buckets], w[buckets]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def remainder() -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, docs) of a task, with its number of documents at bucket -1."""
    counts, docs = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found = gram_counts(text.as_py())[0]
            counts[found] += 1
            docs += len(found) > 0
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found]), pa.array(np.r_[docs, counts[found]])], names=["bucket", "docs"])


def inverse_document_frequencies(texts: DataFrame) -> np.ndarray:
    rows = (texts.mapInArrow(_document_frequencies, "bucket bigint, docs bigint")
            .groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas())
    counts = dict(zip(rows["bucket"], rows["docs"]))
    found = np.array([counts.get(b, 0) for b in range(BUCKETS)], dtype=float)
    return np.log((1 + counts.get(-1, 0)) / (1 + found)) + 1


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, place, found, counts) of a task's sampled rows, one row of each place: others of it are equal."""
    seen = set()
    for batch in batches:
        fresh = []
        for lang, place, text in zip(*(batch.column(c) for c in ("lang", "place", "text"))):
            key = lang.as_py(), place.as_py()
            if key not in seen:
                seen.add(key)
                found, counts = gram_counts(text.as_py())
                fresh.append((*key, found.astype("<u2").tobytes(), counts.astype("<f4").tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(_SAMPLED.names, r)) for r in fresh], schema=_SAMPLED)


def _sample(train: DataFrame, sample: int) -> pd.DataFrame:
    """At most ``sample`` rows with a letter, as many of each language: those of least hash of id and text.

    Equal rows count once. Hashes below a bound that some more rows than needed pass are ranked, without the texts.
    """
    spark = train.sparkSession
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("language sample")), F.lit(PLACES)).alias("place")
    placed = train.select("lang", place, "text")
    sizes = placed.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return pd.DataFrame(columns=_SAMPLED.names)
    quota = sample // len(sizes)
    bounds = spark.createDataFrame([(r["lang"], int(PLACES * min(1.0, (2 * quota + 50) / max(1, r["n"])))) for r in sizes],
                                   "lang string, bound bigint")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    least = (placed.drop("text").join(F.broadcast(bounds), "lang").filter("place < bound").select("lang", "place").distinct()
             .withColumn("rank", rank).filter(F.col("rank") <= quota).drop("rank"))
    return (placed.join(F.broadcast(least), ["lang", "place"]).mapInArrow(_packed_counts, "lang string, place bigint, found binary, counts binary")
            .dropDuplicates(["lang", "place"]).toPandas().sort_values(["place", "lang"], ignore_index=True))


def fit_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """The model of ``docs`` (doc_id, text, lang), learned from its training rows."""
    train = (docs.select("doc_id", "text", "lang").filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
             .filter(remainder() != HELD_OUT))
    nothing = LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    rows = _sample(train, sample)
    if rows.empty:
        return nothing
    pairs = [(np.frombuffer(f, dtype="<u2").astype(np.int64), np.frombuffer(c, dtype="<f4").astype(float))
             for f, c in zip(rows["found"], rows["counts"])]
    rows = rows[[len(f) > 0 for f, _ in pairs]].reset_index(drop=True)
    pairs = [p for p in pairs if len(p[0])]
    names = sorted(set(rows["lang"]))
    if not names:
        return nothing
    labels = rows["lang"].map({name: k for k, name in enumerate(names)}).to_numpy()
    idf = inverse_document_frequencies(train.select("text"))
    samples = [(f, weighted(f, c, idf)) for f, c in pairs]
    fit = [i for i in range(len(samples)) if i % 5] or [0]
    held = [i for i in range(len(samples)) if not i % 5]
    weights, bias = ftrl([samples[i] for i in fit], labels[fit], len(names))
    logits = np.array([x @ weights[f] + bias for f, x in (samples[i] for i in held)])
    return LanguageModel(names, idf, weights.astype(np.float32), bias, best_temperature(logits, labels[held]))


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    held = F.coalesce(remainder() == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, predict("text").alias("p")).select("doc_id", "held_out", "p.*")
