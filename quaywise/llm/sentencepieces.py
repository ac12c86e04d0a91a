"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The text, with one space put before it and spaces written as U+2581, is run through the automaton once. At each position
the automaton's output links give all pieces that end there, and each relaxes the best score of its end from that of
its start; among equal scores the longest last piece wins. A character that no piece covers costs ten less than the
worst piece and is written as its UTF-8 bytes. No piece holds U+2581 behind another character, so a best path is made
of the best paths of the words, and a task keeps those of the words it has met.

The public model is a byte-pair model; its pieces and scores are used as they are, so this gives the segmentation with
the best sum of scores, as the lattice of a unigram model with the same pieces has it, not that of the merges.

Null texts count as empty; an empty text has no tokens. A U+2581 in the text is written as bytes, so that decoding gives
every text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm import textkit
from quaywise.llm.tables import text_of

SPACE, PENALTY = "▁", 10.0
#: Words whose ids a task keeps at most before it starts anew.
HELD_WORDS = 150_000
#: Texts that are taken out of an Arrow batch at a time.
SLICE = 500
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Pieces:
    """What the executors need of a model: ids and scores of the pieces, and the ids of the 256 bytes."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]


def load(path: str = MODEL) -> Pieces:
    """Reads the model on the driver; under 2 MB go to the executors, whatever the input."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError("the model has no pieces for bytes")
    pieces = tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in plain)
    if any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces):
        raise ValueError("a piece reaches over the end of a word")
    return Pieces(pieces, tuple(by_byte[b] for b in range(256)))


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model: Pieces) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in model.pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, _, s in model.pieces) - PENALTY
        self.byte_ids = model.byte_ids
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, i, _ in model.pieces} | {i: bytes([b]) for b, i in enumerate(model.byte_ids)}
        alone = "" if any("\n" in p for p, _, _ in model.pieces) else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + "|\n" * bool(alone))
        self.kept: dict[str, bytes] = {}

    def _as_bytes(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")]

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best path through a text in which spaces are U+2581."""
        n = len(text)
        best, start, piece = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        done = 0

        def settle(to: int) -> None:
            """Positions that no piece ends at, or none of one character, can be reached by an unknown character."""
            nonlocal done
            while done < to:
                done += 1
                if not single[done] and (best[done] is None or best[done - 1] + self.unknown > best[done]):
                    best[done], start[done], piece[done] = best[done - 1] + self.unknown, done - 1, -1

        single = [False] * (n + 1)
        for last, (size, i, score) in self.automaton.iter(text):
            end = last + 1
            settle(last)
            if size == 1:
                single[end] = True
            score += best[end - size]
            if best[end] is None or score > best[end] or (score == best[end] and end - size < start[end]):
                best[end], start[end], piece[end] = score, end - size, i
        settle(n)
        out: list[int] = []
        while n:
            out += [piece[n]] if piece[n] >= 0 else self._as_bytes(text[start[n] : n])[::-1]
            n = start[n]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        kept, parts = self.kept, []
        for k, some in enumerate(text.split(SPACE)):
            if k:
                parts.append(np.array(self._as_bytes(SPACE), np.int32).tobytes())
            for word in self.words.findall(("" if k else SPACE) + some.replace(" ", SPACE)):
                got = kept.get(word)
                if got is None:
                    if len(kept) >= HELD_WORDS:
                        kept.clear()
                    got = np.array(self.viterbi(word), np.int32).tobytes()
                    if len(word) <= 64:
                        kept[word] = got
                parts.append(got)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


def encoded(docs: DataFrame, model: Pieces | None = None, text: str = "text", name: str = "token_ids") -> DataFrame:
    """docs with the ids of their texts as array<int>."""
    sent = docs.sparkSession.sparkContext.broadcast(model or load())

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(sent.value)
        for batch in texts:
            parts, sizes = [np.zeros(0, np.int32)], [0]
            for at in range(0, len(batch), SLICE):
                got = [codec.encode(t) for t in batch.slice(at, SLICE).to_pylist()]
                sizes += map(len, got)
                parts.append(np.concatenate(got))
            values = np.concatenate(parts)
            parts.clear()
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values))
            del values
            textkit.trim()

    return docs.withColumn(name, ids(text_of(text)))


def decoded(rows: DataFrame, model: Pieces | None = None, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """rows with the texts of their ids."""
    sent = rows.sparkSession.sparkContext.broadcast(model or load())

    @F.arrow_udf("string")
    def text(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(sent.value)
        for batch in lists:
            values = batch.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.array(batch.value_lengths().fill_null(0)))
            yield pa.array((codec.decode(x) for x in np.split(values, ends[:-1])) if len(batch) else [], pa.string())

    return rows.withColumn(name, text(F.col(ids)))


def round_trips(docs: DataFrame, model: Pieces | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (32-bit little-endian) and of the decoded text, and whether it is the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for b in (x.slice(at, SLICE) for x in batches for at in range(0, len(x), SLICE)):
            rows = []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t)
                back = codec.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
