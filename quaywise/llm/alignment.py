"""Alignment of two tokenizers: whitespace anchors cut documents into windows of token ids, whose alignments are memoised.

Each text is tokenised whole by both: space and text by a byte-level BPE file (A), the text by a SentencePiece model that
puts a space before it (B). Their tokens are laid over the bytes of space and text; a text whose joined bytes differ in
either (a U+2581 that B takes for a space) has no tokens. Where a token of A and one of B end at the same byte, and the next
token of both begins with a space, is an anchor: no group and no link reaches over it. So a document is a row of windows,
each a tuple of A ids and a tuple of B ids, and what a window holds depends on these two only: its groups (cut where tokens of
both end) and its links (pairs of an A and a B token whose bytes overlap). A Python worker aligns a pair of tuples once and
keeps it, up to HELD windows, then begins anew.

A first pass writes one row a document (its ids, counts and the hash of its groups) and the links of each task by id pair,
summed in the task. Spark sums these to the corpus-wide count of each pair and finds the highest of each B id. The second
pass goes over the written ids and adds the counts of their links up. The counts go to the executors in slices of at most SLICE pairs (24 bytes each), so that what is broadcast has a bound whatever the corpus;
where there are several slices, the documents take one after the other and add up. No links of documents are shuffled.

Huge documents are tokenised in chunks: A by `token_counts.ByteBpe.ids`, B between words, as no piece reaches from
another character to U+2581 and so no merge does. Null and empty texts have no tokens, zeros and an empty groups_sha256. Every
row gives one row; repeated rows count each time; an empty table gives an empty one. Columns that aren't needed are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from quaywise.llm import textkit, token_counts
from quaywise.llm.tables import dropped, stored, text_of

VOCABULARY, MODEL = token_counts.VOCABULARY, "piece_bpe_32k.model"
#: Windows that a Python worker holds, pairs of a row of partial counts, and pairs of a slice of the counts.
HELD, ROW_PAIRS, SLICE = 200_000, 50_000, 2_000_000
#: Characters from which a text is given to SentencePiece in parts.
LONG = 100_000

#: Between the ids of A and those of B in a key of the memo; no id has this value.
_MARK = b"\xff\xff\xff\xff"
_BETWEEN = re.compile(r"(?<=[^ ])(?= .)", re.S)


@lru_cache(maxsize=2)
def pieces(data: bytes) -> Pieces:
    return Pieces(data)


class Pieces:
    """A SentencePiece model whose pieces stay inside words."""

    def __init__(self, data: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec = sentencepiece_model_pb2.ModelProto.FromString(data).normalizer_spec
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        if not spec.add_dummy_prefix or spec.remove_extra_whitespaces or spec.name != "identity" or any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("not a model that keeps texts and has the words' beginnings marked")
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            parts = [t] if len(t) <= LONG else self._parts(t)
            got = [np.array(self.model.encode(p, num_threads=1) if p else [], np.uint32) for p in parts]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Parts of about LONG characters; the space between two stands for the one that the model puts before the second."""
        start = 0
        while len(text) - start > LONG and (m := _BETWEEN.search(text, start + LONG)):
            yield text[start : m.start()]
            start = m.start() + 1
        yield text[start:]


@dataclass
class Windows:
    """The windows of some documents in order: number of the memo's entry of each, and the first of each document."""

    entries: np.ndarray
    starts: np.ndarray


class Aligner:
    """The memo of a worker: what each pair of id tuples holds."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes))
        self.names = np.array([[f"{i}{sign}" for t in (a_bytes, b_bytes) for i in range(len(t))] for sign in (",", "|", ";", "")], dtype=object)
        self.spaced_a, self.spaced_b = (np.array([x[:1] == b" " for x in t]) for t in (a_bytes, b_bytes))
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}  # by the ids of A, a mark and the ids of B
        self.groups: list[str] = []
        self.n_groups: list[int] = []
        self.n_links: list[int] = []
        self.links = array("q")  # of all entries, one behind the other, as a << 32 | b

    def _add(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> None:
        """Aligns new windows, whose ids lie one behind the other; the sizes are their numbers of tokens."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        window_ends = ends_a[np.cumsum(size_a) - 1]
        links, link_ends = _links(a, ends_a, b, ends_b)
        self.links.frombytes(links.tobytes())
        self.n_links += np.diff(np.searchsorted(link_ends, window_ends, "right"), prepend=0).tolist()
        group_ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.n_groups += np.diff(np.searchsorted(group_ends, window_ends, "right"), prepend=0).tolist()
        # Tokens by group, in it those of A first; what stands behind each: , within a side, | between the sides, ; between groups.
        side = np.concatenate([2 * np.searchsorted(group_ends, ends_a), 2 * np.searchsorted(group_ends, ends_b) + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        sign = np.where(side[1:] == side[:-1], 0, np.where(side[1:] % 2 == 1, 1, 2))
        cuts = np.cumsum(size_a + size_b)
        sign = np.append(sign, 3)
        sign[cuts - 1] = 3
        written = self.names[sign, np.concatenate([a, b + np.uint32(len(self.size_a))])[order]].tolist()
        at = 0
        for end in cuts.tolist():
            self.groups.append("".join(written[at:end]))
            at = end

    def windows(self, a: list[np.ndarray], b: list[np.ndarray]) -> Windows:
        """The windows of documents whose tokens cover the same bytes; their ids as arrays of 32 bits."""
        flat_a, flat_b = (np.concatenate([np.zeros(0, np.uint32), *x]) for x in (a, b))
        if not len(flat_a):
            return Windows(np.zeros(0, np.int64), np.zeros(len(a), np.int64))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        last_of_doc = np.zeros(len(flat_a), bool)
        doc_ends = np.cumsum([len(x) for x in a])
        last_of_doc[doc_ends[doc_ends > 0] - 1] = True
        after_a, after_b = np.append(self.spaced_a[flat_a], True)[at_a + 1], np.append(self.spaced_b[flat_b], True)[at_b + 1]
        anchor = (after_a & after_b) | last_of_doc[at_a]
        to_a, to_b = at_a[anchor] + 1, at_b[anchor] + 1
        raw_a, raw_b = flat_a.astype(np.uint32).tobytes(), flat_b.astype(np.uint32).tobytes()
        memo, entries, new, n, i, j = self.memo, [], [], 0, 0, 0
        for x, y in zip((to_a * 4).tolist(), (to_b * 4).tolist(), strict=True):
            key = raw_a[i:x] + _MARK + raw_b[j:y]
            entry = memo.get(key)
            if entry is None:
                entry = memo[key] = len(memo)
                new.append(n)
            entries.append(entry)
            n, i, j = n + 1, x, y
        if new:
            self._add(*_taken(flat_a, to_a, new), *_taken(flat_b, to_b, new))
        starts = np.searchsorted(to_a, np.concatenate(([0], doc_ends[:-1])), "right")
        return Windows(np.array(entries, np.int64), starts)


def _taken(ids: np.ndarray, to: np.ndarray, some: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some of the windows that end at the places `to`, one behind the other, and their numbers."""
    sizes = np.diff(to, prepend=0)
    first, size = (to - sizes)[some], sizes[some]
    return ids[np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)], size


_FIRST = "doc_id long, a binary, b binary, n_groups long, n_links long, groups_sha256 string, pair array<long>, often array<long>"


def _batches(rows: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts, of about 200,000 characters or one text."""
    for b in rows:
        at = 0
        for some in textkit.sliced(b.column(column), 100):
            for start, part in textkit.chunks(some, 200_000):
                yield b.slice(at + start, len(part)), part
            at += len(some)


@lru_cache(maxsize=2)
def _aligner(vocabulary: bytes, model: bytes) -> Aligner:
    return Aligner(token_counts.bpe(vocabulary, False).bytes_of, pieces(model).bytes_of)


def _sums(counts: np.ndarray, memo: Aligner) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs and how often they are linked, if the window of entry i occurs counts[i] times; in parts of ROW_PAIRS."""
    sizes = np.array(memo.n_links[: len(counts)], np.int64)
    pair, where = np.unique(np.array(memo.links[: sizes.sum()], np.int64), return_inverse=True)
    often = np.zeros(len(pair), np.int64)
    np.add.at(often, where, np.repeat(counts, sizes))
    some = np.flatnonzero(often)
    for at in range(0, len(some), ROW_PAIRS):
        part = some[at : at + ROW_PAIRS]
        yield pair[part], often[part]


def tokenised(docs: DataFrame, vocabulary: bytes, model: bytes) -> DataFrame:
    """A row a document (ids as 32-bit little-endian bytes, counts, hash of its groups), and rows of partial counts of pairs."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sp, memo = token_counts.bpe(sent.value[0], False), pieces(sent.value[1]), _aligner(*sent.value)
        counts = np.zeros(0, np.int64)

        def partial() -> Iterator[pa.RecordBatch]:
            for pair, often in _sums(counts, memo):
                cells = [[None], [None], [None], [None], [None], [None], [pair], [often]]
                yield _record(cells)

        for b, texts in _batches(rows, 1):
            spaced = [" " + t if t else "" for t in texts]
            a_ids = [bpe.ids(t) for t in spaced]
            b_ids = sp.ids(texts)
            for i, t in enumerate(spaced):
                raw = t.encode("utf-8", "surrogatepass")
                if bpe.fast.decode_bytes(a_ids[i].tolist()) != raw or b"".join(map(sp.bytes_of.__getitem__, b_ids[i].tolist())) != raw:
                    a_ids[i] = b_ids[i] = np.zeros(0, np.uint32)
            w = memo.windows(a_ids, b_ids)
            n = np.bincount(w.entries, minlength=max(len(memo.memo), len(counts)))
            n[: len(counts)] += counts
            counts = n
            ends = np.append(w.starts[1:], len(w.entries))
            groups, links, digests = [], [], []
            entries = w.entries.tolist()
            for i, j in zip(w.starts.tolist(), ends.tolist(), strict=True):
                own = entries[i:j]
                groups.append(sum(map(memo.n_groups.__getitem__, own)))
                links.append(sum(map(memo.n_links.__getitem__, own)))
                digests.append(hashlib.sha256(";".join(map(memo.groups.__getitem__, own)).encode()).hexdigest() if own else "")
            raw_a, raw_b = ([x.astype("<u4").tobytes() for x in ids] for ids in (a_ids, b_ids))
            none = [None] * len(texts)
            yield _record([b.column(0), raw_a, raw_b, groups, links, digests, none, none])
            if len(memo.memo) > HELD:
                yield from partial()
                memo.clear()
                counts = np.zeros(0, np.int64)
        yield from partial()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _FIRST)


_KINDS = [("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))]


def _record(cells: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k) in zip(cells, _KINDS, strict=True)], names=[n for n, _ in _KINDS])


def pair_counts(first: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked id pair: how often it is linked, and whether none of its B id is linked oftener."""
    rows = first.where(F.col("pair").isNotNull()).select(F.explode(F.arrays_zip("pair", "often")).alias("x"))
    n = rows.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.often").alias("n"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = n.groupBy(b.alias("_b")).agg(F.max("n").alias("_most"))
    return n.withColumn("_b", b).join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


_ADDED = "doc_id long, a binary, b binary, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _links(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of documents that lie one behind the other, as a << 32 | b, and the byte that each ends at.

    Between two neighbours of all ends lies one token of each: these are the overlapping pairs.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, ends)].astype(np.int64), ends


def _found(links: np.ndarray, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The count of each link and whether it is the best of its B id, 0 for those that aren't in the slice."""
    if not len(pair):
        return np.zeros((2, len(links)), np.int64)
    near = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
    there = pair[near] == links
    return np.where(there, n[near], 0), np.where(there, best[near], 0).astype(np.int64)


def _with_slice(rows: DataFrame, part: DataFrame, vocabulary: bytes, model: bytes) -> DataFrame:
    """rows with n_best and count_sum grown by what the pairs of one slice of the counts give; the slice goes to the executors."""
    found = part.toArrow()
    order = np.argsort(found.column("pair").to_numpy())
    table = tuple(found.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    sc = rows.sparkSession.sparkContext
    sent, counts = sc.broadcast((vocabulary, model)), sc.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (token_counts.bpe(sent.value[0], False).bytes_of, pieces(sent.value[1]).bytes_of))
        for b in (x.slice(at, 50) for x in batches for at in range(0, len(x), 50)):
            a_ids, b_ids = ([np.frombuffer(x, "<u4") for x in b.column(k).to_pylist()] for k in (1, 2))
            flat_a, flat_b = np.concatenate(a_ids), np.concatenate(b_ids)
            ends_a, ends_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
            links, of = _links(flat_a, ends_a, flat_b, ends_b)
            distinct, where = np.unique(links, return_inverse=True)
            n, best = _found(distinct, *counts.value)
            last = np.concatenate(([0], np.append(0, ends_a)[np.cumsum([len(x) for x in a_ids])]))
            cuts = np.searchsorted(of, last, "right")
            total = (np.concatenate(([0], np.cumsum(x[where])))[cuts] for x in (best, n))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *(pa.array(b.column(k).to_numpy() + np.diff(t)) for k, t in zip((6, 7), total, strict=True))], names=b.schema.names)

    return rows.mapInArrow(run, _ADDED)


def aligned(docs: DataFrame, vocabulary: bytes | None = None, model: bytes | None = None, slice_pairs: int = SLICE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs."""
    spark = docs.sparkSession
    vocabulary, model = vocabulary or token_counts.read(VOCABULARY), model or token_counts.read(MODEL)
    first = spark.read.parquet(stored(tokenised(docs, vocabulary, model)))
    counts = spark.read.parquet(stored(pair_counts(first)))
    slices = max(1, -(-counts.count() // slice_pairs))
    rows = first.where(F.col("pair").isNull()).select("doc_id", "a", "b", "n_groups", "n_links", "groups_sha256", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    before = None
    for k in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k)
        rows = _with_slice(rows, part, vocabulary, model)
        if k < slices - 1:
            path = stored(rows)
            if before:
                dropped(spark, before)
            rows, before = spark.read.parquet(path), path
    ids = [(F.octet_length(c) / 4).cast("long").alias(f"n_{c}") for c in ("a", "b")]
    return rows.select("doc_id", *ids, "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
