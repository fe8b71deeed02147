"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed 1-grams, 2-grams and 1-skip 2-grams of its lower-cased
words. FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves all but a few
thousand weights at zero, so the model is a short list of (bucket, weight) whose size is bounded by
``BUCKETS`` and checked before it is sent to the executors.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``, taken in the order of a hash of
the id): features are extracted in parallel and one task runs the sequential updates over them. Scoring
reads every text whole, in one pass, without a shuffle.

Defined results: a null or empty text, or one without words, has no features and gets the score of the
intercept; repeated rows score alike; a null id counts as not held out; labels that are null are not
learned from, and of several labels of one id the largest counts; without any label, or with one class
only, the score is that class's smoothed share; an empty table gives an empty result. Columns other
than the id and the text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.store import ship, table, tidy

BUCKETS = 1 << 24
#: At most so many labelled rows are learned from.
FIT_ROWS = 16_384
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
#: A model with more weights than this is refused rather than sent.
MAX_WEIGHTS = 2_000_000
THRESHOLD = 0.3
#: Words whose hashes a worker keeps.
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Word -> 32-bit hash; emptied when it is full, so its memory is bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams and skip-grams, repeats included."""
    words = _WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint32, len(words))
    parts = [_mix(h)]
    if len(h) > 1:
        parts.append(_mix(h[:-1] * np.uint32(0x9E3779B1) + h[1:] + np.uint32(1)))
    if len(h) > 2:
        parts.append(_mix(h[:-2] * np.uint32(0x85EBCA77) + h[2:] + np.uint32(2)))
    return np.concatenate(parts)


def fit_ftrl(rows: list[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Sequential FTRL-proximal over (distinct buckets, label) rows, which it empties -> intercept, buckets, weights."""
    seen = np.zeros(BUCKETS, bool)
    for f, _ in rows:
        seen[f] = True
    every = np.flatnonzero(seen).astype(np.uint32)
    del seen
    labels, at = [y for _, y in rows], []
    for i, (f, _) in enumerate(rows):  # the places take the room of the buckets
        at.append(np.searchsorted(every, f).astype(np.int32))
        rows[i] = (None, 0.0)
    rows = labels
    z, n = np.zeros(len(every)), np.zeros(len(every))
    good = sum(labels)
    prior = (good + 0.5) / (len(rows) + 1.0) if rows else 0.5
    b, bn = float(np.log(prior / (1 - prior))), 0.0
    if rows and 0 < good < len(rows):
        for _ in range(epochs):
            for i, y in zip(at, rows, strict=True):
                zi, ni = z[i], n[i]
                w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
                g = p - y
                root = np.sqrt(ni + g * g)
                z[i] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
                n[i] = ni + g * g
                bn += g * g
                b -= ALPHA / (BETA + np.sqrt(bn)) * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    keep = w != 0
    return b, every[keep], w[keep]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"o": pdf["o"], "y": pdf["y"], "f": [np.unique(features(t)).astype(np.int32) for t in pdf["text"]]})
    tidy()


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for pdf in batches:
        rows += [(o, np.array(f, np.uint32), float(y)) for o, y, f in zip(pdf["o"], pdf["y"], pdf["f"], strict=True)]
    rows.sort(key=lambda r: r[0])
    pairs = [(f, y) for _, f, y in rows]
    del rows
    b, at, w = fit_ftrl(pairs)
    del pairs
    tidy()
    yield pd.DataFrame({"bucket": np.concatenate([[-1], at.astype(np.int64)]), "weight": np.concatenate([[b], w])})


class Model:
    """An intercept and sparse weights; ``score(column)`` is a column of probabilities."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray):
        self.bias, self.buckets, self.weights = bias, buckets, weights

    def score_texts(self, texts) -> np.ndarray:
        table_ = np.zeros(BUCKETS, np.float32)  # untouched pages of it take no memory
        table_[self.buckets] = self.weights
        return np.array([self._one(t, table_) for t in texts], np.float64)

    def _one(self, text: str | None, table_: np.ndarray) -> float:
        f = features(text)
        hit = np.unique(f[table_[f] != 0])
        return 1.0 / (1.0 + np.exp(-np.clip(float(table_[hit].astype(np.float64).sum()) + self.bias, -35, 35)))

    def score(self, spark: SparkSession, text: Column) -> Column:
        ship(spark)
        sent = spark.sparkContext.broadcast((self.bias, self.buckets, self.weights))

        @F.pandas_udf("double")
        def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = Model(*sent.value)
            table_ = np.zeros(BUCKETS, np.float32)
            table_[model.buckets] = model.weights
            for texts in batches:
                yield pd.Series([model._one(t, table_) for t in texts], dtype="float64")
            tidy()

        return toxicity.asNondeterministic()(text)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) that are not held out and have a document."""
    ship(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("o", F.xxhash64("doc_id"))
    some = known.orderBy("o", "doc_id").limit(fit_rows)
    rows = F.broadcast(some).join(docs.select("doc_id", "text"), "doc_id")  # fit_rows ids: a few hundred KB
    rows = rows.groupBy("doc_id").agg(F.first("o").alias("o"), F.first("y").cast("double").alias("y"), F.min("text").alias("text"))
    seen = rows.select("o", "y", "text").mapInPandas(_extract, "o long, y double, f array<int>")
    out = seen.repartition(1).mapInPandas(_train, "bucket long, weight double").limit(MAX_WEIGHTS + 1).toPandas()
    if len(out) > MAX_WEIGHTS:
        raise ValueError(f"the model has over {MAX_WEIGHTS} weights; raise L1")
    bias = out.loc[out["bucket"] < 0, "weight"]
    rest = out[out["bucket"] >= 0].sort_values("bucket")
    return Model(float(bias.iloc[0]) if len(bias) else 0.0, rest["bucket"].to_numpy(np.int64), rest["weight"].to_numpy(np.float64))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(spark, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    model = fit(spark, docs, labels)
    kept = docs.withColumn("__tessera_score", model.score(spark, F.col("text"))).where(F.col("__tessera_score") < threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
