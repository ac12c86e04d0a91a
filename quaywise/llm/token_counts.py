"""Token counts of a byte-level BPE vocabulary, huge documents by overlapping chunks that are spliced where they agree.

A text of up to CHUNK + OVERLAP characters is encoded at once. A longer one is cut every CHUNK characters, each chunk
reaching OVERLAP characters into the next. Two neighbours are spliced at a place in their overlap where a token ends in
both (their tokens carry byte offsets) and which is proven stable; what the left one has before it and the right one has
behind it are the text's own tokens. Where the overlap has no such place, it is doubled, up to the end of the text if
need be (a word of many megabytes), and the left chunk is encoded anew.

A place is proven stable if the characters beside it say so, whatever else the text holds. The vocabulary's pattern cuts a
text from left to right into runs of letters, of digits, of other signs (each with at most one space before it), white
space and contractions, looking one character ahead and never back. So no match reaches from a character that isn't white
space over a change of class, unless that character is an apostrophe before a letter; merges stay inside matches. A place
inside a special token is passed over, as the text is cut around those first.

The counts are those of the library `tokenizers` for the same file. The ids come from `tiktoken` with the ranks that this
file gives, as that takes a fifth of the time and gives the same ids for every code point (the tests hold both together);
stretches of over LONG_RUN characters go through `tokenizers`, whose pattern engine bears them.

Null and empty texts have no tokens. Special strings inside texts are tokens, as the library has them by default. Every row
gives one row, repeated ones and those with null ids too; an empty table gives an empty one. A document is one cell and so
one task's, which holds a chunk's tokens besides the text itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quaywise.llm import textkit
from quaywise.llm.tables import text_of

CHUNK, OVERLAP, LONG_RUN = 16_384, 256, 200_000
#: Tokens that a document may have.
LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"

#: Between two characters of which the first isn't white space and no match holds both.
STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def read(name: str = VOCABULARY) -> bytes:
    """A vocabulary file, read on the driver; it goes to the executors whole (under 2 MB, whatever the input)."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder of one byte-level BPE file; special: whether the strings of special tokens are those tokens."""

    def __init__(self, data: bytes, special: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_of()
        ranks = {bytes(map(letters.__getitem__, k)): i for k, i in model["vocab"].items() if k not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges))
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"] or spec["normalizer"] or not in_order:
            raise ValueError("not a plain byte-level BPE file whose ids are in the order of its merges")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a special token takes text beside it")
        self.chunk, self.overlap = chunk, min(overlap, chunk)
        self.special = added if special else {}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.data, self.plain = data, not special
        self.bytes_of = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.reach = max((len(s) for s in self.special), default=0)
        self.chunks = self.widened = 0

    @cached_property
    def slow(self) -> Tokenizer:
        """The library's own encoder, which few workers need."""
        library = Tokenizer.from_str(self.data.decode())
        library.encode_special_tokens = self.plain
        return library

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text that is encoded at once."""
        self.chunks += 1
        if len(text) > LONG_RUN:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def _in_special(self, text: str, at: int) -> bool:
        """Whether a place of the text may lie inside a special token."""
        near = text[max(0, at - self.reach) : at + self.reach]
        return any(s in near for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text of any length."""
        if len(text) <= self.chunk + self.overlap:
            return self.whole(text) if text else np.zeros(0, np.uint32)
        parts, start, done, width = [], 0, 0, self.overlap
        seam = self.chunk
        left = self.whole(text[: seam + width])
        while True:
            ends = np.cumsum(self.sizes[left])
            spliced = None if seam + width >= len(text) else self._splice(text, start, seam, width, ends)
            if spliced:
                bytes_before, right_start, right, done_in_right = spliced
                parts.append(left[np.searchsorted(ends, done, "right") : np.searchsorted(ends, bytes_before, "right")])
                start, left, done, seam, width = right_start, right, done_in_right, right_start + self.chunk, self.overlap
            elif seam + width >= len(text):
                parts.append(left[np.searchsorted(ends, done, "right") :])
                return np.concatenate(parts)
            else:
                width *= 2
                self.widened += 1
                left = self.whole(text[start : seam + width])

    def _splice(self, text: str, start: int, seam: int, width: int, ends: np.ndarray) -> tuple[int, int, np.ndarray, int] | None:
        """Where the chunk that begins at `start`, with tokens ending at `ends`, can be spliced with the next one in the overlap behind the seam.

        (bytes of the chunk before the place, start and ids of the next chunk, bytes of that before the place), or None.
        """
        next_start, right, right_ends = -1, None, None
        for m in STABLE.finditer(text, seam + 1, seam + width - 1):
            at = m.start()
            if self._in_special(text, at):
                continue
            before = len(text[start:at].encode("utf-8", "surrogatepass"))
            if not _has(ends, before):
                continue
            if right is None:
                next_start = max(seam, at - self.overlap)
                right = self.whole(text[next_start : next_start + self.chunk + self.overlap])
                right_ends = np.cumsum(self.sizes[right])
            done = len(text[next_start:at].encode("utf-8", "surrogatepass"))
            if _has(right_ends, done):
                return before, next_start, right, done
        return None


def _has(ends: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(ends, at))
    return i < len(ends) and ends[i] == at


@lru_cache(maxsize=4)
def bpe(data: bytes, special: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> ByteBpe:
    """The encoder of a Python worker, which keeps it for its next tasks."""
    return ByteBpe(data, special, chunk, overlap)


COUNTED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_widened", T.LongType())])


def counted(docs: DataFrame, data: bytes | None = None, text: str = "text", name: str = "tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a struct of n_tokens, n_chunks (encoded for it) and n_widened (overlaps that were doubled)."""
    sent = docs.sparkSession.sparkContext.broadcast(data or read())

    @F.arrow_udf(COUNTED)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = bpe(sent.value, True, chunk, overlap)
        for batch in texts:
            rows = []
            for some in textkit.sliced(batch, 100):
                for t in some:
                    codec.chunks = codec.widened = 0
                    rows.append((len(codec.ids(t)), codec.chunks, codec.widened))
            cols = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.StructArray.from_arrays([pa.array(cols[:, k]) for k in range(3)], names=COUNTED.names)

    return docs.withColumn(name, count(text_of(text)))


def token_counts(docs: DataFrame, data: bytes | None = None, limit: int = LIMIT, **how: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks and n_widened for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    c = counted(rows, data, **how)
    return c.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "tokens.n_tokens", (F.col("tokens.n_tokens") > limit).alias("over_limit"), "tokens.n_chunks", "tokens.n_widened")
