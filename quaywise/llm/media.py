"""Media columns: texts as 8-bit PNG images in a binary column, and low-frequency cosine-transform hashes of them.

A payload is padded with spaces to a positive multiple of 192 bytes and becomes an RGB image of 64 pixels a row. The
encoder filters each row with the one of none, sub and up that leaves the least sum of absolute residuals; the decoder
checks the signature and every chunk's CRC, inflates the image data and undoes all five filters of the format.

The hash of an image: its grey values are averaged onto 32 by 32 cells, and of the cosine transform the 64 lowest
frequencies are compared with their median (the constant term left out of it). Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm import textkit
from quaywise.llm.tables import text_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Rows of the cosine transform of 32 values for its 8 lowest frequencies.
COSINES = np.cos(np.pi / 32 * (np.arange(32) + 0.5)[None, :] * np.arange(8)[:, None])


def pad(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An RGB image of 64 pixels a row that holds the payload, whose length is a positive multiple of 192."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.concatenate([best[:, None].astype(np.uint8), kinds[best, np.arange(len(rows))]], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    for y in np.flatnonzero(kinds):
        row, kind = rows[y], kinds[y]
        above = rows[y - 1] if y else np.zeros_like(row)
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        else:
            values, over = row.tolist(), above.tolist()
            for x in range(len(values)):
                a, b, c = (values[x - step] if x >= step else 0), over[x], (over[x - step] if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                values[x] = (values[x] + guess) & 255
            row[:] = values
    return rows


def decode_png(image: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit grey or RGB image; ValueError if a checksum or a size is wrong."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, data, ended = 8, None, [], False
    while at < len(image) and not ended:
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if len(image) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2) or head[4:] != (0, 0, 0):
        raise ValueError("only whole images with 8 bits a sample, grey or RGB, not interlaced")
    step = 3 if head[3] == 2 else 1
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(lines) != head[1] * (head[0] * step + 1):
        raise ValueError("the image data have the wrong length")
    return _unfilter(lines.reshape(head[1], -1), step)


def _cells(values: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal parts along the first axis; parts that hold less than a row repeat the row they begin in."""
    size = len(values)
    edges = np.arange(n) * size // n
    if size >= n:
        return np.add.reduceat(values, edges, axis=0) / np.diff(np.append(edges, size))[:, None]
    return values[edges]


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> str:
    """16 hex digits of an image's low frequencies."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2, dtype=np.float64)
    cells = _cells(_cells(grey, 32).T, 32).T
    low = np.round(COSINES @ cells @ COSINES.T, 6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def with_images(docs: DataFrame, text: str = "text", level: int = 1) -> DataFrame:
    """docs with `media`, the PNG of the padded text."""

    @F.arrow_udf("binary")
    def image(texts: pa.Array) -> pa.Array:
        return pa.array((encode_png(pad(t.encode("utf-8", "surrogatepass")), level) for some in textkit.sliced(texts) for t in some), pa.binary())

    return docs.withColumn("media", image(text_of(text)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and what is read back from the stored image, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in (x.slice(at, 500) for x in batches for at in range(0, len(x), 500)):
            rows = []
            for n, image in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                samples = decode_png(image)
                payload = samples.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    rows = with_images(rows).select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
