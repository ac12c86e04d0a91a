"""Quality: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its white-space separated words, its pairs of neighbouring words (all pairs of a word with itself
are one feature, so that repetition shows whatever the word) and its character n-grams (2 and 3 code points), hashed into
buckets. Each bucket has a learned vector; the mean of a document's vectors goes through
a softmax layer. Both are trained by stochastic gradient descent, a document a step. The softmax of two classes depends
on the vectors only through their product with the difference of the two output rows, so scoring keeps one number a
bucket.

Null and empty texts get the score of the bias alone. Without labels to learn from the score is 0.5. A very long text is
averaged whole, as any other; a task takes texts by the hundred thousand characters, or one at a time if longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm import textkit
from quaywise.llm.tables import fold, labelled_sample, text_of


@dataclass(frozen=True)
class QualityParams:
    """max_rows: labelled texts to learn from, at most; bits: log2 of the buckets; dim: of the vectors;
    boost: how much faster vectors move than the output rows, as each holds a small share of a document."""

    max_rows: int = 4000
    orders: tuple[int, ...] = (2, 3)
    bits: int = 17
    dim: int = 8
    epochs: int = 6
    rate: float = 0.2
    boost: float = 50.0
    seed: int = 7


def _buckets(some: list[str], p: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every feature, once for each kind of feature."""
    pad = max(p.orders) - 1
    points, starts, lengths = textkit.padded(some, pad)
    place = np.arange(len(points))
    owner = np.repeat(np.arange(len(some)), lengths + pad)
    real = place - starts[owner] < lengths[owner]
    for _, h in textkit.gram_hashes(points, p.orders, p.bits):
        yield owner[: len(h)][real[: len(h)]], h[real[: len(h)]]
    data = [t.encode("utf-8", "surrogatepass") for t in some]
    joint = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    first, end = textkit.word_spans(joint)
    begins = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
    words = textkit.word_hashes(joint, first, end)
    doc = np.searchsorted(begins, first, "right") - 1
    yield doc, (words >> np.uint64(64 - p.bits)).astype(np.int32)
    pair = np.where(words[:-1] == words[1:], np.uint64(0), textkit.mix(words[:-1] * np.uint64(3) + words[1:]) >> np.uint64(64 - p.bits))
    same = doc[:-1] == doc[1:]
    yield doc[1:][same], pair[same].astype(np.int32)


def fit(texts: list[str], labels: np.ndarray, p: QualityParams) -> tuple[np.ndarray, float]:
    """The vectors times the difference of the output rows, and the difference of the biases."""
    size = 1 << p.bits
    if not len(texts):
        return np.zeros(size, np.float32), 0.0
    bags = []
    for _, some in textkit.chunks(texts):
        parts = list(_buckets(some, p))
        owner, bucket = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        key, count = np.unique(owner.astype(np.int64) << p.bits | bucket, return_counts=True)
        cuts = np.searchsorted(key >> p.bits, np.arange(1, len(some)))
        for k, c in zip(np.split((key & (size - 1)).astype(np.int32), cuts), np.split(count, cuts), strict=True):
            bags.append((k, (c / max(c.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (size, p.dim)).astype(np.float32)
    out, bias, steps = np.zeros((2, p.dim), np.float32), np.zeros(2, np.float32), p.epochs * len(texts)
    t = 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            rate = np.float32(p.rate * (1 - t / steps))
            t += 1
            k, share = bags[i]
            hidden = share @ vectors[k]
            z = out @ hidden + bias
            e = np.exp(z - z.max())
            err = e / e.sum()
            err[labels[i]] -= 1
            back = out.T @ err
            out -= rate * np.outer(err, hidden)
            bias -= rate * err
            vectors[k] -= (rate * p.boost) * share[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts: list[str], line: np.ndarray, bias: float, p: QualityParams) -> np.ndarray:
    got = []
    for _, some in textkit.chunks(texts):
        total, number = np.zeros(len(some)), np.zeros(len(some))
        for owner, bucket in _buckets(some, p):
            total += np.bincount(owner, weights=line[bucket], minlength=len(some))
            number += np.bincount(owner, minlength=len(some))
        got.append(total / np.maximum(number, 1) + bias)
    return textkit.sigmoid(np.concatenate(got)) if got else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> tuple[np.ndarray, float]:
    """The model, fitted in one task on the bounded sample; 0.5 MB of numbers come back."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        line, bias = fit(texts, np.array(y, dtype=np.int64), p)
        yield pa.RecordBatch.from_pydict({"line": pa.array([line.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    sample = labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1, p.max_rows)
    row = sample.coalesce(1).mapInArrow(one, "line binary, bias double").first()
    return (np.zeros(1 << p.bits, np.float32), 0.0) if row is None else (np.frombuffer(row.line, "<f4"), row.bias)


def score_column(docs: DataFrame, model: tuple[np.ndarray, float], p: QualityParams = QualityParams()) -> Column:
    """The score of docs.text as a column, for callers that keep the row's other columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(scores(some, *sent.value, p) for some in textkit.sliced(text))]), pa.float64())

    return quality(text_of())


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 3) == 1).alias("held_out"), score_column(docs, model, p).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
