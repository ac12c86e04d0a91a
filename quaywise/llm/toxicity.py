"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (3 to 6 code points of its lower-cased whole text, hashed). For each n-gram
the log of the ratio of its smoothed shares in toxic and clean training texts is taken; n-grams that don't differ between
the classes beyond chance are left out, and a logistic model is fitted on the remaining features, each scaled by its
ratio and by how often it stands in the text (words that are rare slips in clean texts are frequent in toxic ones).

Null and empty texts get the score of a text without features. Where no label of either class is there to learn from,
the score is the share of label 1 among what was learnt from (0.5 without any). A very long text is scored whole, as any
other; a task takes texts by the hundred thousand characters, or one at a time if longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm import textkit
from quaywise.llm.tables import fold, labelled_sample, text_of


@dataclass(frozen=True)
class ToxicityParams:
    """max_rows: labelled texts to learn from, at most; bits: log2 of the hashed features; z: standard deviations by
    which a feature's counts must differ between the classes; steps and l2: of the logistic fit."""

    max_rows: int = 6000
    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 20
    min_docs: int = 3
    z: float = 4.0
    per_chars: int = 1000
    steps: int = 400
    l2: float = 1e-4


def _features(texts: list[str], p: ToxicityParams, keep: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the text, its distinct features, their strengths), of those that `keep` marks.

    A feature's strength is log2(1 + its occurrences in a thousand characters), a text of less counting as a thousand.
    """
    pad = max(p.orders) - 1
    for first, some in textkit.chunks([t.lower() for t in texts]):
        points, starts, lengths = textkit.padded(some, pad)
        found = [[] for _ in some]
        for _, h in textkit.gram_hashes(points, p.orders, p.bits):
            if keep is None:
                for i, (s, n) in enumerate(zip(starts, lengths, strict=True)):
                    found[i].append(h[s : s + n])
                continue
            at = np.flatnonzero(keep[h])
            doc = np.searchsorted(starts, at, "right") - 1
            inside = at - starts[doc] < lengths[doc]
            at, doc = at[inside], doc[inside]
            for i, part in zip(np.unique(doc), np.split(h[at], np.flatnonzero(np.diff(doc)) + 1), strict=False):
                found[i].append(part)
        for i, parts in enumerate(found):
            f, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0))
            yield first + i, f, np.log2(1 + n * (p.per_chars / max(lengths[i], p.per_chars)))


def _certainty(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Root of the likelihood-ratio statistic of each feature against the classes, in standard deviations."""
    have, out = counts.sum(axis=0), np.zeros(counts.shape[1])
    for c in (0, 1):
        for observed, total in ((counts[c], have), (n[c] - counts[c], n.sum() - have)):
            out += observed * np.log(np.maximum(observed, 1e-12) / np.maximum(total * n[c] / n.sum(), 1e-12))
    return np.sqrt(np.maximum(2 * out, 0))


def fit(texts: list[str], labels: np.ndarray, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weight of every feature (its ratio times its coefficient; 0 if it was left out) and the intercept."""
    counts = np.zeros((2, 1 << p.bits), dtype=np.float64)
    for i, f, _ in _features(texts, p, None):
        counts[labels[i], f] += 1
    n = np.bincount(labels, minlength=2)
    if not n.all():
        rate = (n[1] + 1e-9) / (n.sum() + 2e-9)
        return np.zeros(1 << p.bits, np.float32), float(np.clip(np.log(rate / (1 - rate)), -20, 20))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    keep = (_certainty(counts, n) >= p.z) & (counts.sum(axis=0) >= p.min_docs)
    number = np.cumsum(keep) - 1
    rows, cols, strengths = [], [], []
    for i, f, strength in _features(texts, p, keep):
        rows.append(np.full(len(f), i))
        cols.append(number[f])
        strengths.append(strength)
    row, col = np.concatenate(rows), np.concatenate(cols)
    x, m, y = ratio[keep][col] * np.concatenate(strengths), int(keep.sum()), labels.astype(np.float64)
    w, b = np.zeros(m + 1), np.log(n[1] / n[0])
    w[m] = b
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, p.steps + 1):
        z = np.bincount(row, weights=x * w[col], minlength=len(y)) + w[m]
        err = textkit.sigmoid(z) - y
        grad = np.append(np.bincount(col, weights=x * err[row], minlength=m) / len(y) + p.l2 * w[:m], err.mean())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << p.bits, dtype=np.float32)
    weights[keep] = ratio[keep] * w[:m]
    return weights, float(w[m])


def scores(texts: list[str], weights: np.ndarray, intercept: float, p: ToxicityParams) -> np.ndarray:
    out, keep = np.full(len(texts), intercept), weights != 0
    for i, f, strength in _features(texts, p, keep):
        out[i] += (weights[f] * strength).sum(dtype=np.float64)
    return textkit.sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> tuple[np.ndarray, float]:
    """The model, fitted in one task on the bounded sample; 4 MB of weights come back."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
        w, b0 = fit(texts, np.array(y, dtype=np.int64), p)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype("<i4").tobytes()], pa.binary()), "w": pa.array([w[at].astype("<f4").tobytes()], pa.binary()), "b": pa.array([b0], pa.float64())})

    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0, p.max_rows)
    row = sample.coalesce(1).mapInArrow(one, "at binary, w binary, b double").first()
    weights = np.zeros(1 << p.bits, dtype=np.float32)
    if row is None:
        return weights, 0.0
    weights[np.frombuffer(row.at, "<i4")] = np.frombuffer(row.w, "<f4")
    return weights, row.b


def score(docs: DataFrame, model: tuple[np.ndarray, float], p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b0 = sent.value
        for b in batches:
            got = np.concatenate([np.zeros(0), *(scores(some, weights, b0, p) for some in textkit.sliced(b.column(2)))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
