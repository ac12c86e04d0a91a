"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against the indexed blocks of the corpus itself.

The corpus is dealt into reference blocks of a bounded size. A block's index are its seeds: the hashes of all runs of
`window` words, each with the first place it stands at. The reference of a window is the earliest place in any block's
index (smaller id, or the same document and an earlier start). A document is parsed from left to right: at the first
window with a reference a factor begins and goes on as long as the reference does, word by word inside its own block, by
the references that advance with it in another. The parse goes on behind the factor, but for the check at its end: the
windows that cross it, of which the factor says nothing, are looked up like any other, and the first of them with a
reference begins the next factor. So every word that a window with an earlier copy covers lies in a factor, and no other
word does. All factors are `window` words or longer; they are the duplicate spans, and what they cover is what goes.

A document meets every block, but no block is sent to every document. Each window of 20 words is represented by its
least 8-gram (its anchor; neighbours mostly share it); blocks exchange their distinct anchors, and only windows whose
anchor occurs in another block are looked up in the distributed index, as 128-bit hashes, one row for each distinct
window of a block. So a passage that a third of all documents hold is one row a block, not one a document, and what
repeats inside a block is settled there. Inside a block the words themselves are compared: each distinct word of a block has
a number, and a factor goes on as long as the numbers are equal. Across blocks equality is that of 128 bits, which come
from the bytes of the words through two independent scrambling hashes (for the 10^13 windows of 100 TB, one wrong match is
to be expected in about 10^12 runs).

Words are runs of anything but ASCII white space, unchanged. Null texts have no words. Null ids come last in the order;
documents of one id are ordered by block, and by text inside it. Repeated rows are dealt by the partition they were read
in as well, so that they don't all meet in one block. A very long text is a block of its own if longer than one.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.llm import textkit
from quaywise.llm.tables import quoted, text_of

#: Words of a window and of an anchor, and the bytes of text that a block holds, about.
WINDOW, ANCHOR, BLOCK_BYTES = 20, 8, 8_000_000
_LAST = (1 << 63) - 1
_BASES = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
_STEPS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def _runs(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each run of n values: those of two halves are scrambled together, again and again."""
    base, step = _BASES[seed], _STEPS[seed]
    out, done, have, size, todo = None, 0, h, 1, n
    while len(h) >= n:
        if todo & 1:
            if out is None:
                out, done = have, size
            else:
                m = len(h) - done - size + 1
                out, done = textkit.mix(out[:m] * base + textkit.mix(have[done : done + m] + step)), done + size
        todo >>= 1
        if not todo:
            return out
        have = textkit.mix(have[:-size] * base + textkit.mix(have[size:] + step))
        size *= 2
    return np.zeros(0, np.uint64)


class Block:
    """The words of a block's documents in order, as two independent hashes each, and the hashes of its windows."""

    def __init__(self, table: pa.Table, window: int) -> None:
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i], texts[i]))
        self.ids = np.array([_LAST if ids[i] is None else ids[i] for i in self.order], dtype=np.int64)
        self.data = [texts[i].encode("utf-8", "surrogatepass") for i in self.order]
        self.window = window
        parts, counts = ([], []), np.zeros(len(self.data), np.int64)
        at = 0
        while at < len(self.data):
            end, held = at, 0
            while end < len(self.data) and (end == at or held + len(self.data[end]) < 400_000):
                held += len(self.data[end]) + 1
                end += 1
            joint = np.frombuffer(b" ".join(self.data[at:end]) + b" ", dtype=np.uint8)
            first, past = textkit.word_spans(joint)
            begins = np.cumsum([0, *(len(d) + 1 for d in self.data[at:end])])
            counts[at:end] = np.diff(np.searchsorted(first, begins))
            for seed in (0, 1):
                parts[seed].append(textkit.word_hashes(joint, first, past, seed))
            at = end
        self.hashes = tuple(np.concatenate([np.zeros(0, np.uint64), *p]) for p in parts)
        self.counts, self.begins = counts, np.concatenate(([0], np.cumsum(counts)))
        left = np.repeat(self.begins[1:], counts) - np.arange(self.begins[-1])
        self.starts = np.flatnonzero(left >= window)
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def numbers(self) -> np.ndarray:
        """The words as numbers, equal ones for equal words only."""
        of: dict[bytes, int] = {}
        return np.fromiter((of.setdefault(w, len(of)) for d in self.data for w in d.split()), np.int64, self.begins[-1])

    def anchors(self) -> np.ndarray:
        """The least 8-gram of each window."""
        k = min(ANCHOR, self.window)
        least, size, span = textkit.mix(_runs(self.hashes[0], k, 1)), 1, self.window - k + 1
        while size * 2 <= span and len(least) > size:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span and len(least) > span - size:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        return least[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def seeds(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows that start there."""
        return tuple(_runs(self.hashes[k], self.window, k)[starts] if len(starts) else np.zeros(0, np.uint64) for k in (0, 1))

    def earliest(self, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each of the windows, in order of place, the number of the first one equal to it."""
        order = np.argsort(a, kind="stable")
        new = np.concatenate(([True], a[order][1:] != a[order][:-1])) if len(a) else np.zeros(0, bool)
        if len(a) and (~new & np.concatenate(([False], b[order][1:] != b[order][:-1]))).any():
            order = np.lexsort((b, a))
            new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        first = np.zeros(len(a), np.int64)
        first[order] = order[new][np.cumsum(new) - 1] if len(a) else order
        return first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(docs: DataFrame, block_bytes: int, carry: list[str]) -> DataFrame:
    """docs with the number of their block; blocks hold about block_bytes bytes, whatever the ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *[F.col(quoted(c)).alias(f"_c_{i}") for i, c in enumerate(carry)])
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, -(-total // block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(number)))


def _looked_up(blocks: DataFrame, window: int, where: bool) -> DataFrame:
    """Of each block, the windows with an earlier copy in another block: (block, at, ref_at), and where the copy is: (ref_doc, ref_start).

    at is a position in the block's words; ref_at has the number of the other block, plus one, in its upper half.
    """

    def anchors(table: pa.Table) -> pa.Table:
        found = np.unique(Block(table, window).anchors())
        textkit.trim()
        return pa.table({"block": pa.repeat(table.column("block")[0], len(found)), "anchor": _signed(found)})

    kinds = [("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())] + [("start", pa.int64())] * where

    def seeds(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({k: pa.array([], t) for k, t in kinds})
        block = Block(left, window)
        shared = np.sort(right.column("anchor").to_numpy().view(np.uint64))
        least = block.anchors()
        near = np.minimum(np.searchsorted(shared, least), len(shared) - 1)
        starts = block.starts[shared[near] == least]
        a, b = block.seeds(starts)
        one = block.earliest(starts, a, b) == np.arange(len(starts))
        starts, a, b = starts[one], a[one], b[one]
        textkit.trim()
        doc, place = block.doc[starts], (left.column("block")[0].as_py() << 32) + starts
        cols = [_signed(a), _signed(b), pa.array(block.ids[doc]), pa.array(place)]
        return pa.table(dict(zip([k for k, _ in kinds], cols + [pa.array(starts - block.begins[doc])] * where, strict=True)))

    known = blocks.groupBy("block").applyInArrow(anchors, "block long, anchor long")
    every = W.partitionBy("anchor")
    shared = known.withColumns({"lo": F.min("block").over(every), "hi": F.max("block").over(every)}).where("lo <> hi").select("block", "anchor")
    index = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(seeds, "a long, b long, doc long, place long" + ", start long" * where)
    same = W.partitionBy("a", "b").orderBy("doc", "place").rowsBetween(W.unboundedPreceding, 0)
    more = {"ref_doc": F.first("doc").over(same), "ref_start": F.first("start").over(same)} if where else {}
    hits = index.withColumns({"ref": F.first("place").over(same)} | more).where("place <> ref")
    return hits.select(F.shiftright("place", 32).alias("block"), F.col("place").bitwiseAND((1 << 32) - 1).alias("at"), (F.col("ref") + (1 << 32)).alias("ref_at"), *more)


#: What a parse gives for each document.
PARSED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("factors", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ref_doc", "ref_start")]))),
    ]
)


def _factors(block: Block, at: np.ndarray, ref_at: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(number of the window it begins with, start, length) of each factor of a block's documents, in order.

    at are the starts of the windows that have a reference, in order; ref_at are the references: a place in the block, or,
    with the number of another block in the upper half, one that is there.
    """
    if not len(at):
        return []
    words, doc, ends = block.numbers(), block.doc, block.begins[1:]
    breaks = np.flatnonzero((at[1:] != at[:-1] + 1) | (ref_at[1:] != ref_at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])) + 1
    run_end = np.append(breaks, len(at))[np.searchsorted(breaks, np.arange(len(at)), "right")]
    out, i = [], 0
    while i < len(at):
        start, ref = int(at[i]), int(ref_at[i])
        length = int(run_end[i]) - i + window - 1
        if ref < 1 << 32:
            most = int(min(ends[doc[start]] - start, ends[doc[ref]] - ref))
            same, step = 0, window
            while same < most:
                n = min(step, most - same)
                differs = np.flatnonzero(words[start + same : start + same + n] != words[ref + same : ref + same + n])
                if len(differs):
                    same += int(differs[0])
                    break
                same, step = same + n, 2 * step
            length = same
        if length >= window:
            out.append((i, start, length))
            i = int(np.searchsorted(at, start + length - window + 1))  # the first window that crosses the end
        else:
            i += 1
    return out


def parse(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = (), kept: bool = False, factors: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept and factors for every row of docs, and its columns `carry` as _c_0, _c_1, ...

    kept (the words that no factor covers, joined by a space) and factors (start and length in words, and the document
    and start of the reference) are null unless asked for.
    """
    blocks = _blocks(docs, block_bytes, list(carry))
    extra = [blocks.schema[f"_c_{i}"] for i in range(len(carry))]
    schema = T.StructType([*PARSED.fields, *extra])

    def factored(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, window)
        starts = block.starts
        first = block.earliest(starts, *block.seeds(starts))
        block.hashes = ()  # not needed any more
        copy, ref_at = first != np.arange(len(starts)), starts[first]
        ref_doc, ref_start = block.ids[block.doc[ref_at]], ref_at - block.begins[block.doc[ref_at]]
        if len(right):
            far = np.searchsorted(starts, right.column("at").to_numpy())
            copy[far] = True
            for ours, name in ((ref_at, "ref_at"), (ref_doc, "ref_doc"), (ref_start, "ref_start"))[: 3 if factors else 1]:
                ours[far] = right.column(name).to_numpy()
        found = _factors(block, starts[copy], ref_at[copy], window)
        edge = np.zeros(block.begins[-1] + 1, np.int64)
        begins, lengths = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + lengths, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[block.begins])
        lists: list[list[dict]] = [[] for _ in block.ids]
        if factors:
            ref_doc, ref_start = ref_doc[copy], ref_start[copy]
            for i, start, length in found:
                d = block.doc[start]
                lists[d].append({"start": int(start - block.begins[d]), "length": length, "ref_doc": int(ref_doc[i]), "ref_start": int(ref_start[i])})
        left_over, digests, order = [], [], block.order
        for i, d in enumerate(block.data):
            words = d.split()
            if n_removed[i]:
                words = compress(words, ~gone[block.begins[i] : block.begins[i + 1]])
            text = b" ".join(words)
            digests.append(hashlib.sha256(text).hexdigest())
            left_over.append(text.decode("utf-8", "surrogatepass") if kept else None)
        cols = {
            "doc_id": left.column("doc_id").take(order),
            "n_words": pa.array(block.counts),
            "n_removed": pa.array(n_removed),
            "kept_sha256": pa.array(digests, pa.string()),
            "kept": pa.array(left_over, pa.string()),
            "factors": pa.array(lists if factors else [None] * len(lists), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "ref_doc", "ref_start")]))),
        }
        del block, left_over, lists, gone, edge
        textkit.trim()
        return pa.table(cols | {f.name: left.column(f.name).take(order) for f in extra})

    return blocks.groupBy("block").cogroup(_looked_up(blocks, window, factors).groupBy("block")).applyInArrow(factored, schema)


def duplicate_spans(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id and its factors, a row each: start, length, ref_doc, ref_start."""
    return parse(docs, factors=True, **how).select("doc_id", F.inline("factors"))


def deduplicated(docs: DataFrame, block_bytes: int = BLOCK_BYTES // 2, **how: object) -> DataFrame:
    """docs with their texts replaced by what no factor covers; all rows and columns stay (n_chars is counted anew if there).

    Blocks are half as large as those of `removal`, as a task holds the texts that are left and the other columns as well.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    rows = parse(docs, carry=others, kept=True, block_bytes=block_bytes, **how)
    rows = rows.select("doc_id", F.col("kept").alias("text"), *[F.col(f"_c_{i}").alias(c) for i, c in enumerate(others)])
    if "n_chars" in others:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select([quoted(c) for c in docs.columns])


def removal(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is left, for every row of docs."""
    return parse(docs, **how).select("doc_id", "n_words", "n_removed", "kept_sha256")
