"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased, everything but letters becomes one space, and all n-grams of 1 to 3 code points that aren't
spaces alone are counted. A language's profile are the most frequent n-grams of its training texts in order; a
document's are its own most frequent ones. The distance is the sum over the document's n-grams of how far the ranks
are apart, or of a fixed penalty where the profile lacks the n-gram. Equal counts are ordered by the n-gram.

The language with the least distance is predicted (the first by name among equals); the score is the share of the
largest possible distance that isn't used up. Null texts and texts without letters are `und` with score 0, and so is
every text where there is nothing to learn from. A very long text is ranked whole, as any other; what a task holds for
it is a few arrays of 8 bytes a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.llm import textkit
from quaywise.llm.tables import fold, text_of


@dataclass(frozen=True)
class LanguageParams:
    """ranks: n-grams of a profile; distinct n-grams that a language's counting holds before it passes them on."""

    orders: tuple[int, ...] = (1, 2, 3)
    ranks: int = 400
    held: int = 400_000


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], orders: tuple[int, ...]) -> np.ndarray:
    """The n-grams of the texts as integers: 21 bits a code point, a space before the first and after the last word of each."""
    joint = "\1".join(f" {t.lower()} ".replace("\1", " ") for t in texts)
    points = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points] | (points == 1), points, 32).astype(np.uint64)
    space = points == 32
    points = points[~(space & np.concatenate(([False], space[:-1])))]
    if len(points) < 2:
        return np.zeros(0, np.uint64)
    out, h, whole = [], points, points != 1
    for n in range(1, max(orders) + 1):
        if n > 1:
            h, whole = (h[:-1] << np.uint64(21)) | points[n - 1 :], whole[:-1] & (points[n - 1 :] != 1)
        if n in orders:
            out.append(h[whole & (h != 32)] if n == 1 else h[whole])
    return np.concatenate(out)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def top(keys: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by the n-gram."""
    key, n = _counts(keys)
    if len(key) > ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        key, n = key[n >= least], n[n >= least]
    return key[np.argsort(-n, kind="stable")][:ranks]


def profiles(docs: DataFrame, p: LanguageParams = LanguageParams()) -> dict[str, list[int]]:
    """The ranked n-grams of each language, counted over all training documents (crc32 of the id modulo 5 isn't 0).

    Tasks sum their counts before the shuffle; one row a language and rank, `ranks` times the languages, comes back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            parts = held.pop(lang)
            key, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(n, first).astype(np.int64))], ["lang", "gram", "n"])

        for b in batches:
            for at in range(0, len(b), 500):
                by: dict[str, list[str]] = {}
                for text, lang in zip(b.column(0).slice(at, 500).to_pylist(), b.column(1).slice(at, 500).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    for _, some in textkit.chunks(texts, 300_000):
                        key, n = _counts(grams(some, p.orders))
                        if len(key):
                            held.setdefault(lang, []).append((key, n))
                        if sum(len(k) for k, _ in held.get(lang, [])) > p.held:
                            yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 5) != 0))
    sums = seen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", rank).where(F.col("rank") <= p.ranks).select("lang", "gram", "rank").orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict(docs: DataFrame, known: dict[str, list[int]], p: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(sent.value)
        all_grams = np.unique(np.concatenate([np.array(sent.value[x], np.uint64) for x in names])) if names else np.zeros(0, np.uint64)
        ranks = np.full((len(names), len(all_grams) + 1), -1, dtype=np.int32)
        for i, x in enumerate(names):
            ranks[i, np.searchsorted(all_grams, np.array(sent.value[x], np.uint64))] = np.arange(len(sent.value[x]))

        def one(text: str) -> tuple[str, float]:
            mine = top(grams([text], p.orders), p.ranks)
            if not len(mine) or not names:
                return "und", 0.0
            at = np.searchsorted(all_grams, mine)
            at[at < len(all_grams)] = np.where(all_grams[at[at < len(all_grams)]] == mine[at < len(all_grams)], at[at < len(all_grams)], len(all_grams))
            theirs = ranks[:, at]
            apart = np.where(theirs < 0, p.ranks, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
            best = int(np.argmin(apart))
            return names[best], float(1 - apart[best] / (p.ranks * len(mine)))

        for b in batches:
            got = [one(t) for some in textkit.sliced(b.column(2)) for t in some]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
