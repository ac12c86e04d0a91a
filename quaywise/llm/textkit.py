"""Small numpy helpers that the operators of this subpackage use inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: ASCII white space that separates words, as bytes.split() and the class [\x20\x09-\x0D] have it.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of a word that is hashed apart.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def sliced(texts: pa.Array, rows: int = 500) -> Iterator[list[str]]:
    """The texts of an Arrow batch as lists of so many, so that few are held as Python strings at a time."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def chunks(texts: list[str], limit: int = 120_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `limit` characters with the index of their first; a longer text is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def padded(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by `pad` zeros; first positions; lengths without the zeros."""
    joint = ("\0" * pad).join(texts) + "\0" * pad
    points = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + pad, out=starts[1:])
    return points, starts, lengths


def gram_hashes(points: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bucket of the n-gram that starts at each position); the array is len(points) - order + 1 long."""
    shift, h = np.uint64(64 - bits), points.astype(np.uint64) + np.uint64(1)
    base = h
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(h) < 2:
                return
            h = h[:-1] * _BASE + base[n - 1 :]
        if n in orders:
            x = (h + np.uint64(n)) * _MIX1
            yield n, (((x ^ (x >> np.uint64(29))) * _MIX2) >> shift).astype(np.int32)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte positions of the runs of bytes that aren't ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACES[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word: eight bytes at a time, each scrambled with what came before it.

    Long words (over LONG_WORD bytes) are hashed by XXH3 of their bytes. Hashes of two seeds are independent.
    """
    sizes = ends - starts
    h = mix((sizes.astype(np.uint64) + np.uint64(seed + 1)) * _BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left = np.flatnonzero(sizes <= LONG_WORD)
    at = 0
    while len(left):
        first, rest = starts[left] + at, sizes[left] - at
        part = np.zeros(len(left), np.uint64)
        for k in range(8):
            part |= np.where(k < rest, padded[np.minimum(first + k, len(data))], 0).astype(np.uint64) << np.uint64(8 * k)
        h[left] = mix((h[left] ^ part) * _MIX1 + _BASE)
        at += 8
        left = left[rest > 8]
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed))
    return mix(h)


def trim() -> None:
    """Gives memory that was freed back to the system, as a Python worker lives on for the stages behind this one."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
