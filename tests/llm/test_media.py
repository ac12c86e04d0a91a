import hashlib
import struct
import zlib

import numpy as np
import odd
import pytest
from quaywise.llm import media


def filtered(rows, kinds, step):
    """Image data filtered by the format's formulas, a byte at a time."""
    out = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for x, v in enumerate(rows[y]):
            a = int(rows[y][x - step]) if x >= step else 0
            b = int(rows[y - 1][x]) if y else 0
            c = int(rows[y - 1][x - step]) if y and x >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(v) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


def image(rows, kinds, colour, parts=1):
    step = 3 if colour == 2 else 1
    data = zlib.compress(filtered(rows, kinds, step))
    cuts = [data[i * len(data) // parts : (i + 1) * len(data) // parts] for i in range(parts)]
    head = struct.pack(">IIBBBBB", len(rows[0]) // step, len(rows), 8, colour, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"a\0b") + b"".join(media._chunk(b"IDAT", c) for c in cuts) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2])
def test_decodes_all_filters(colour):
    rows = np.random.default_rng(1).integers(0, 256, (10, 30), dtype=np.uint8)
    assert np.array_equal(media.decode_png(image(rows, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], colour, parts=3)), rows)
    assert np.array_equal(media.decode_png(image(rows, [4, 3, 2, 1, 0, 2, 2, 2, 4, 1], colour)), rows)


def test_notices_damage():
    good = media.encode_png(media.pad(b"some text" * 50))
    for at in (0, 17, 45, len(good) - 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(good[:-12])


def test_hash_is_the_plain_cosine_transform():
    for n in (1, 5, 32, 77):
        rows = np.random.default_rng(n).integers(0, 256, (n, 192), dtype=np.uint8)
        grey = rows.reshape(n, 64, 3).mean(axis=2)
        cell = np.zeros((32, 32))
        for i in range(32):
            a, b = i * n // 32, (i + 1) * n // 32
            cell[i] = grey[a : max(b, a + 1)].mean(axis=0).reshape(32, 2).mean(axis=1)
        low = [[sum(cell[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        flat = np.round(np.array(low).reshape(-1), 6)
        bits = "".join("1" if x > np.median(flat[1:]) else "0" for x in flat)
        assert media.cosine_hash(rows) == f"{int(bits, 2):016x}"


def test_odd_rows(spark):
    got = media.features(odd.docs(spark)).collect()
    want = []
    for r in odd.rows():
        data = (r[1] or "").encode()
        payload = data + b" " * ((-len(data)) % 192 or 192 * (not data))
        want.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    assert all(by.setdefault(r.payload_sha256, (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes) for r in got)
    assert media.features(odd.empty(spark)).collect() == []


def test_image_column_can_be_read_back(spark):
    for r in media.with_images(odd.docs(spark)).select("text", "media").collect():
        assert media.decode_png(bytes(r.media)).tobytes() == media.pad((r.text or "").encode())
